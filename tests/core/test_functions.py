"""Column functions and schema conversion."""

import pytest
from pyspark.errors import PySparkException
import pyspark.sql.functions as F
import pyspark.sql.types as T

from kinfold.functions import fields, text, vectors
from kinfold.operators import profiling, schema


def apply(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r.x for r in df.select("i", f(F.col("s")).alias("x")).orderBy("i").collect()]


@pytest.mark.parametrize("exact", [False, True])
def test_normalize_name(spark, exact):
    given = ["Apple Inc.", "O'Brien & Associates, L.L.C.", "  Multiple   Spaces  ", "Café Zürich", "a_b", "", None, "!!!"]
    assert apply(spark, lambda c: text.normalize_name(c, exact), given) == ["apple inc", "o brien associates l l c", "multiple spaces", "cafe zurich", "a_b", "", None, ""]


def test_exact_normalising_covers_other_scripts(spark):
    assert apply(spark, lambda c: text.normalize_name(c, True), ["ﬁne Ά"]) == ["fine α"]


def test_basename_and_ending(spark):
    names = ["Apple Inc.", "Google LLC", "Alphabet Corporation", "Foo Bar, Ltd.", "Siemens AG", "Inc", "Coastal", None]
    assert apply(spark, text.basename, names) == ["Apple", "Google", "Alphabet", "Foo Bar", "Siemens", "Inc", "Coastal", None]
    assert apply(spark, text.corporate_ending, ["Apple Corporation", "Coastal", None]) == ["Corporation", "", None]


def test_acronym(spark):
    assert apply(spark, text.acronym, ["International Business Machines", "Microsoft", "Bank of America Corp", "", None, "The A of B"]) == ["IBM", None, "BA", None, None, None]


def test_strip_domain(spark):
    assert apply(spark, text.strip_domain, ["amazon.com", "amazon.co.uk", "Amazon", "example.ai", "X.COM", None]) == ["amazon", "amazon", "Amazon", "example", "X", None]


def test_name_keys_are_distinct_and_never_empty(spark):
    assert apply(spark, text.name_keys, ["Big Data Company Inc.", "x", "", None]) == [["big data company inc", "big data", "BD"], ["x"], [], []]


def test_stop_words():
    assert {"the", "and", "der", "le", "el"} <= text.STOP_WORDS


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0])], "a array<float>, b array<float>")
    got = df.select(vectors.dot(F.col("a"), F.col("b")).alias("d"), vectors.cosine(F.col("a"), F.col("b")).alias("c"), vectors.l2_normalize(F.col("a")).alias("u")).collect()
    assert [r.d for r in got] == [24.0, 0.0, None] and got[0].c == pytest.approx(0.96) and got[1].c == 0.0 and got[2].c is None
    assert got[0].u == pytest.approx([0.6, 0.8]) and got[1].u == [0.0, 0.0] and got[2].u is None


@pytest.mark.parametrize(
    ("field", "values", "kind"),
    [
        ("other", ["a@b.co", "x@y.org"], "email"), ("x", ["https://a.b", "http://c"], "url"), ("x", ["0", "17", "4.5"], "numeric"),
        ("revenue", ["1234567", "7654321"], "numeric"), ("x", ["1999-05-06", "2001-07-08"], "date"), ("notes", ["12 34", "!!", "56ab78"], "text"),
        ("description", ["a" * 150], "text"), ("phone", ["x"], "phone"), ("address", ["1"], "address"), ("sku", ["q"], "identifier"), ("who", ["Ann Lee", "Bo"], "name"),
        ("x", ["1234567"], "phone"), ("x", ["1/2/2024"], "date"), ("x", [None, " "], "text"), ("Product Name", ["7"], "name"),
    ],
)
def test_field_types(spark, field, values, kind):
    df = spark.createDataFrame([(v,) for v in values], T.StructType([T.StructField(field, T.StringType())]))
    assert profiling.profile_columns(df).first().inferred_type == kind


def test_type_of_name():
    assert fields.type_of_name("E Mail") == "email" and fields.type_of_name("whatever") is None


def test_profile(spark):
    rows = [("Ann", "http://a", 5, 1.0), ("Bo", None, 6, float("nan")), ("Cy", "http://c", 6, None)]
    p = {r.field: r for r in profiling.profile_columns(spark.createDataFrame(rows, "name string, url string, revenue long, d double")).collect()}
    assert p["url"].completeness == 0.6667 and p["revenue"].uniqueness == 0.6667 and p["d"].completeness == 0.3333
    assert [f for f in p if p[f].is_blocking] == ["name"] and {f for f in p if p[f].is_matching} == {"name", "url"}
    assert p["name"].sample_values == ["Ann", "Bo", "Cy"]
    empty = profiling.profile_columns(spark.createDataFrame([], "name string, n int"))
    assert [(r.field, r.completeness) for r in empty.collect()] == [("n", 0.0), ("name", 0.0)]
    quick = {r.field: r.uniqueness for r in profiling.profile_columns(spark.createDataFrame(rows, "name string, url string, revenue long, d double"), approximate=True).collect()}
    assert quick["name"] == 1.0
    config = profiling.suggested_config(profiling.profile_columns(spark.createDataFrame(rows, "name string, url string, revenue long, d double")), 3)
    assert config["name_field"] == "name"
    rate = profiling.duplicate_rate(profiling.profile_columns(spark.createDataFrame([("a",), ("a",)], "name string"))).first()[0]
    assert rate == 0.5


def test_widen_keeps_order_and_nullability(spark):
    s = T.StructType.fromDDL("b INT NOT NULL, a STRING, c ARRAY<ARRAY<INT>>, d MAP<STRING, INT>, e STRUCT<f: FLOAT>")
    assert schema.widen(s) == T.StructType.fromDDL("b BIGINT NOT NULL, a STRING, c ARRAY<ARRAY<BIGINT>>, d MAP<STRING, BIGINT>, e STRUCT<f: DOUBLE>")
    assert schema.widen_ints(spark.createDataFrame([(1,)], "x int")).dtypes == [("x", "bigint")]


def test_conform(spark):
    df = schema.conform(spark.createDataFrame([(1, "2", 3)], "a int, b string, z int"), T.StructType.fromDDL("b BIGINT, missing STRING, a STRING"))
    assert df.dtypes == [("b", "bigint"), ("missing", "string"), ("a", "string")] and df.first() == (2, None, "1")


def test_required_columns(spark):
    with pytest.raises(ValueError, match="entities"):
        schema.require_columns(spark.createDataFrame([("k", "t", 1)], "block_key string, block_key_type string, block_size int"))


def test_decisions_bound_confidence(spark):
    ok = schema.decisions(spark.createDataFrame([(1, 2, True, 0.5, "r")], schema.DECISIONS))
    assert ok.first().is_match
    with pytest.raises(PySparkException):
        schema.decisions(spark.createDataFrame([(1, 2, True, 1.5, "r")], schema.DECISIONS)).collect()


def test_schema_of_a_record():
    class Record:
        name: str
        n: int | None
        xs: list[int]
        extra: dict

    s = schema.schema_of(Record)
    assert [(f.name, f.dataType.simpleString(), f.nullable) for f in s.fields] == [("name", "string", False), ("n", "bigint", True), ("xs", "array<bigint>", False), ("extra", "map<string,string>", False)]


def test_described_schema():
    d = schema.described(T.StructType.fromDDL("er_id BIGINT, venue STRING, year INT NOT NULL, tags ARRAY<STRING>"), {"venue": "text"})
    assert [(x["field"], x["type"], x["required"]) for x in d] == [("venue", "str | None", False), ("year", "int", True), ("tags", "list[str] | None", False)]


def test_normalize_name_passes_over_a_text_once(spark):
    """two passes of expressions, and letters looked up in texts that have no marks."""
    import pyspark.sql.functions as F

    from kinfold.functions.text import _FROM, _TO, normalize_name

    odd = ["a,\u00a0 b", "\u2003x\u0085y_z--", "É\u0301t\u00e9 — n\u00ba1", "tab\t\n.;x", "\u0130\U0001d400 ok", "", None, " ..  ", "\u1680q\u200bq\ufeff"]
    d = spark.createDataFrame([(x,) for x in odd], "n string")
    two = F.regexp_replace(F.lower(F.regexp_replace(F.translate("n", _FROM, _TO), r"\p{M}+", "")), r"(?U)[^\w\s]", " ")
    for r in d.select("n", normalize_name(F.col("n")).alias("one"), F.trim(F.regexp_replace(two, r"(?U)\s+", " ")).alias("two")).collect():
        assert r.one == r.two
    plan = d.select(normalize_name(F.col("n")).alias("one"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 2 and "CASE WHEN" in plan
