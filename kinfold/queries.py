"""The entity-resolution queries over the standard tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
import pyspark.sql.functions as F

from kinfold.functions import text as T
from kinfold.functions.fields import votes
from kinfold.functions.vectors import cosine, l2_normalize, norm
from kinfold.operators import blocking, entities, graph, lineage, matching, merge, metrics, pairs, profiling, schema
from kinfold.plans.config import ResolveConfig, Settings
from kinfold.plans.resolve import resolve
from kinfold.session import shared_folder
from kinfold.sources import benchmarks, files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


# --- scalar functions ---

NORMAL = r"trim(regexp_replace(regexp_replace(lower(strip_accents({0})), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"
HOST = r"regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)"


@query("normalize_name", f"SELECT doc_id, md5({NORMAL.format('text')}) AS normal_md5 FROM documents")
def normalize_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalize_name(F.col("text"))).alias("normal_md5"))


@query("normalize_name_any_script", f"SELECT doc_id, md5({NORMAL.format('text')}) AS normal_md5 FROM documents")
def normalize_name_any_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalize_name(F.col("text"), exact=True)).alias("normal_md5"))


def _host() -> Column:
    return F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1)


_ENDS = "|".join(e.replace(".", r"\.") for e in T.DOMAIN_ENDS)


@query("strip_domain", f"SELECT page_id, trim(regexp_replace({HOST}, '({_ENDS})$', '', 'i')) AS stem FROM pages")
def strip_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.strip_domain(_host()).alias("stem"))


_FORMS = ["Inc.", "LLC", "GmbH", "Corporation", "Ltd.", "& Co. KG", ""]
_COMPANY_SQL = "p_partkey, p_name || CASE CAST(p_partkey % 7 AS INTEGER) " + " ".join(f"WHEN {i} THEN '{' ' + f if f else ''}'" for i, f in enumerate(_FORMS)) + " END AS company"


def _companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names with a legal form by key, as there are no companies in the tables."""
    form = F.element_at(F.array(*[F.lit(f" {f}" if f else "") for f in _FORMS]), (F.col("p_partkey") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", form).alias("company"), "p_name")


@query("basename", rf"""
    SELECT p_partkey, CASE CAST(p_partkey % 7 AS INTEGER) WHEN 5 THEN p_name || ' &' ELSE p_name END AS base,
           CASE CAST(p_partkey % 7 AS INTEGER) {" ".join(f"WHEN {i} THEN '{'Co. KG' if i == 5 else f}'" for i, f in enumerate(_FORMS))} END AS ending
    FROM part""")  # fmt: skip
def basename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _companies(spark, sf_dir).select("p_partkey", T.basename(F.col("company")).alias("base"), T.corporate_ending(F.col("company")).alias("ending"))


_STOPS = ", ".join(f"'{w}'" for w in sorted(T.STOP_WORDS))


@query("acronym", f"""
    WITH w AS (SELECT p_partkey, list_filter(string_split({NORMAL.format("p_name || ' of the ' || p_type")}, ' '), lambda x: length(x) > 1 AND x NOT IN ({_STOPS})) AS ws FROM part)
    SELECT p_partkey, CASE WHEN len(ws) >= 2 THEN upper(array_to_string(list_transform(ws, lambda x: x[1]), '')) END AS acronym FROM w""")  # fmt: skip
def acronym(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.acronym(F.concat("p_name", F.lit(" of the "), "p_type")).alias("acronym"))


# --- rows ---


@query("entity_projection", """
    SELECT c_custkey AS er_id, c_name AS name, c_mktsegment AS description, 'customer' AS entity_type,
           CAST(c_custkey AS VARCHAR) || '/' || CAST(c_nationkey AS VARCHAR) || '/' || c_mktsegment AS attributes_text, c_name || ' ' || c_mktsegment AS embedding_text
    FROM customer""")  # fmt: skip
def entity_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = entities.to_entities(table(spark, sf_dir, "customer"), "c_custkey", "c_name", entity_type="customer")
    shown = F.concat_ws("/", F.col("er_id").cast("string"), F.element_at("attributes", F.lit("c_nationkey")), F.element_at("attributes", F.lit("c_mktsegment")))
    return rows.select("er_id", "name", "description", "entity_type", shown.alias("attributes_text"), entities.embedding_text(["c_mktsegment"]).alias("embedding_text"))


@query("column_roles", "SELECT * FROM (VALUES ('documents', 'text', 'lang,source'), ('part', 'p_name', 'p_brand,p_type'), ('pages', 'url', 'html')) t(table_name, name_column, text_columns)")
def column_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = []
    for name in ("documents", "part", "pages"):
        df = table(spark, sf_dir, name)
        hit = entities.name_column(df)
        found.append((name, hit, ",".join(entities.text_columns(df, hit))))
    return spark.createDataFrame(found, "table_name string, name_column string, text_columns string")


@query("dense_id", "SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS er_id FROM orders")
def dense_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.dense_id(table(spark, sf_dir, "orders").select("o_orderkey"), order="o_orderkey").select("o_orderkey", "er_id")


@query("two_tables", """
    SELECT c_custkey AS er_id, c_name AS name, 'l' AS side FROM customer
    UNION ALL SELECT s_suppkey + 100000, s_name, 'r' FROM supplier""")  # fmt: skip
def two_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    right = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    both = entities.two_tables(left, right, "key")
    return both.select("er_id", "name", F.when(F.map_contains_key("attributes", F.lit("l_name")), "l").otherwise("r").alias("side"))


@query("conform", "SELECT doc_id AS er_id, CAST(NULL AS VARCHAR) AS name, lang, CAST(n_chars AS DOUBLE) AS n_chars FROM documents")
def conform(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.types import StructType

    wanted = StructType.fromDDL("er_id BIGINT, name STRING, lang STRING, n_chars DOUBLE")
    return schema.conform(schema.widen_ints(table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "er_id")), wanted)


@query("local_ids", "SELECT p_partkey, p_name, CAST(row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) - 1 AS BIGINT) AS local_id FROM part")
def local_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.local_ids(table(spark, sf_dir, "part").select("p_partkey", "p_name"), ["p_name"], "p_partkey")


# --- filters ---


@query("label_filter", "SELECT d.doc_id, d.lang FROM documents d WHERE d.doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def label_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1")
    return table(spark, sf_dir, "documents").join(good, "doc_id", "left_semi").select("doc_id", "lang")


@query("block_limit", "SELECT p_partkey AS er_id, p_name AS block_key FROM part WHERE p_name IN (SELECT DISTINCT p_name FROM part ORDER BY p_name LIMIT 10)")
def block_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.first_blocks(_part_blocks(spark, sf_dir), 10).select("er_id", "block_key")


# --- blocks and pairs ---


def _part_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.key_blocks(table(spark, sf_dir, "part"), F.col("p_name"), "p_partkey")


@query("key_blocks", "SELECT p_partkey AS er_id, p_name AS block_key, CAST(count(*) OVER (PARTITION BY p_name) AS INTEGER) AS block_size FROM part")
def key_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part_blocks(spark, sf_dir)


@query("salt_blocks", """
    WITH b AS (SELECT p_partkey AS er_id, p_name AS block_key, count(*) OVER (PARTITION BY p_name) AS n, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS rn FROM part)
    SELECT er_id, block_key, CAST(n AS INTEGER) AS block_size, CAST(CASE WHEN n > 10 THEN floor((rn - 1) / 10) ELSE 0 END AS INTEGER) AS salt_id FROM b""")  # fmt: skip
def salt_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.salt(_part_blocks(spark, sf_dir), 10).select("er_id", "block_key", "block_size", "salt_id")


_STATS = """
    WITH s AS (SELECT count(*) AS n FROM part GROUP BY p_name)
    SELECT count(*) AS total_blocks, CAST(sum(n) AS BIGINT) AS total_entities, round(avg(n), 6) AS avg_block_size, max(n) AS max_block_size,
           count(*) FILTER (WHERE n = 1) AS singleton_blocks, CAST(sum(n * (n - 1) / 2) AS BIGINT) AS candidate_pairs,
           round(1.0 - CAST(sum(n * (n - 1) / 2) AS DOUBLE) / CAST(sum(n) * (sum(n) - 1) / 2 AS DOUBLE), 6) AS reduction_ratio FROM s"""


@query("blocking_stats", _STATS)
def blocking_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = blocking.blocking_stats(_part_blocks(spark, sf_dir))
    return s.withColumns({c: F.round(c, 6) for c in ("avg_block_size", "reduction_ratio")})


_SALTED = "SELECT p_partkey, p_name, floor((row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) - 1) / 10) AS salt FROM part"


@query("candidate_pairs", f"WITH s AS ({_SALTED}) SELECT x.p_partkey AS a, y.p_partkey AS b FROM s x JOIN s y ON x.p_name = y.p_name AND x.salt = y.salt AND x.p_partkey < y.p_partkey")
def candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs within runs of ten rows, so they grow with the rows, not with a block's square."""
    return pairs.candidate_pairs(blocking.salt(_part_blocks(spark, sf_dir), 10).drop("block_size"))


@query("name_key_blocks", f"""
    WITH n AS (SELECT p_partkey AS er_id, {NORMAL.format("p_name")} AS nm FROM part),
         k AS (SELECT er_id, nm AS block_key FROM n UNION SELECT er_id, upper(array_to_string(list_transform(list_filter(string_split(nm, ' '), lambda x: length(x) > 1 AND x NOT IN ({_STOPS})), lambda x: x[1]), ''))
               FROM n WHERE len(list_filter(string_split(nm, ' '), lambda x: length(x) > 1 AND x NOT IN ({_STOPS}))) >= 2)
    SELECT er_id, block_key, CAST(count(*) OVER (PARTITION BY block_key) AS INTEGER) AS block_size FROM k""")  # fmt: skip
def name_key_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.name_blocks(table(spark, sf_dir, "part"), "p_name", "p_partkey")


def _clusters(spark: SparkSession, sf_dir: str, *keys: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.concat_ws("|", *keys).alias("cluster_id"), F.col("p_partkey").alias("entity_id"))


_PAIRS = "SELECT DISTINCT x.p_partkey AS a, y.p_partkey AS b FROM part x JOIN part y ON {0} AND x.p_partkey < y.p_partkey"
_SAME = {"p": "x.p_name = y.p_name AND x.p_brand = y.p_brand", "t": "x.p_name = y.p_name AND x.p_brand = y.p_brand AND x.p_type = y.p_type"}
_FROM_COUNTS = """
    SELECT tp AS true_positives, p - tp AS false_positives, t - tp AS false_negatives, round(coalesce(tp / nullif(p, 0), 0), 6) AS "precision",
           round(coalesce(tp / nullif(t, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(p + t, 0), 0), 6) AS f1_score FROM c"""
_RATES = f"""
    WITH p AS ({_PAIRS.format(_SAME["p"])}), t AS ({_PAIRS.format(_SAME["t"])}),
         c AS (SELECT (SELECT count(*) FROM p JOIN t USING (a, b)) AS tp, (SELECT count(*) FROM p) AS p, (SELECT count(*) FROM t) AS t) {_FROM_COUNTS}"""
_LINKED = "SELECT DISTINCT l_partkey AS a, l_suppkey + 100000000 AS b FROM lineitem WHERE l_returnflag IN ({0})"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1_score")})


def _linked(spark: SparkSession, sf_dir: str, *flags: str) -> DataFrame:
    """Pairs of a part and a supplier that lines of these flags link; as many as lines at most."""
    return table(spark, sf_dir, "lineitem").where(F.col("l_returnflag").isin(*flags)).select(F.col("l_partkey").alias("a"), (F.col("l_suppkey") + 100_000_000).alias("b"))


_ITEM = "l_orderkey * 10 + l_linenumber"


@query("cluster_pairs", f"""
    WITH i AS (SELECT l_orderkey AS c, {_ITEM} AS e FROM lineitem)
    SELECT DISTINCT x.e AS a, y.e AS b FROM i x JOIN i y ON x.c = y.c AND x.e < y.e""")  # fmt: skip
def cluster_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of each order's lines: clusters of a size that doesn't grow."""
    return pairs.cluster_pairs(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("cluster_id"), F.expr(_ITEM).alias("entity_id")))


@query("pair_metrics", f"""
    WITH p AS ({_LINKED.format("'A', 'R'")}), t AS ({_LINKED.format("'R', 'N'")}),
         c AS (SELECT (SELECT count(*) FROM p JOIN t USING (a, b)) AS tp, (SELECT count(*) FROM p) AS p, (SELECT count(*) FROM t) AS t) {_FROM_COUNTS}""")  # fmt: skip
def pair_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.pair_metrics(_linked(spark, sf_dir, "A", "R"), _linked(spark, sf_dir, "R", "N")))


@query("cluster_f1", _RATES)
def cluster_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.cluster_metrics(_clusters(spark, sf_dir, "p_name", "p_brand"), _clusters(spark, sf_dir, "p_name", "p_brand", "p_type")))


@query("pair_completeness", f"""
    WITH c AS ({_LINKED.format("'A', 'R'")}), t AS ({_LINKED.format("'R', 'N'")})
    SELECT round(coalesce((SELECT count(*) FROM c JOIN t USING (a, b)) / nullif((SELECT count(*) FROM t), 0), 0), 6) AS pair_completeness""")  # fmt: skip
def pair_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.pair_completeness(_linked(spark, sf_dir, "A", "R"), _linked(spark, sf_dir, "R", "N"))
    return found.withColumn("pair_completeness", F.round("pair_completeness", 6))


@query("predicted_pairs", """
    WITH m AS (SELECT min(p_partkey) OVER (PARTITION BY p_name) AS a, p_partkey AS b FROM part),
         d AS (SELECT DISTINCT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b FROM lineitem WHERE l_returnflag = 'R' AND l_partkey <> l_suppkey)
    SELECT a, b FROM m WHERE a < b UNION SELECT a, b FROM d""")  # fmt: skip
def predicted_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positive decisions and the lineage of merged parts."""
    decided = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("entity_a_id"), F.col("l_suppkey").alias("entity_b_id"), (F.col("l_returnflag") == "R").alias("is_match"))
    return pairs.predicted(decided, merge.merge_components(_part_entities(spark, sf_dir)))


@query("match_decisions", "SELECT l_partkey AS entity_a_id, l_suppkey AS entity_b_id, l_returnflag = 'R' AS is_match, l_discount AS confidence, l_returnflag AS reasoning FROM lineitem")
def match_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("entity_a_id"), F.col("l_suppkey").alias("entity_b_id"), (F.col("l_returnflag") == "R").alias("is_match"), F.col("l_discount").alias("confidence"), F.col("l_returnflag").alias("reasoning"))
    return schema.decisions(d)


# --- sets ---


@query("dedup_exact", "SELECT lang, source, count(*) AS n, count(DISTINCT text) AS distinct_texts FROM documents GROUP BY lang, source")
def dedup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("lang", "source", F.xxhash64("text").alias("h"), F.md5("text").alias("m"))
    each = d.groupBy("lang", "source", "h", "m").agg(F.count(F.lit(1)).alias("c"))
    return each.groupBy("lang", "source").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("distinct_texts"))


@query("set_operations", """
    WITH a AS (SELECT l_partkey AS a, l_suppkey AS b FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT l_partkey AS a, l_suppkey AS b FROM lineitem WHERE l_returnflag = 'A')
    SELECT 'both' AS part, a, b FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'first', a, b FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
    UNION ALL SELECT 'any', a, b FROM (SELECT * FROM a UNION SELECT * FROM b)""")  # fmt: skip
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intersection, difference and union of two pair sets in one shuffle of either side."""
    d = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag").isin("R", "A"))
    sides = d.groupBy(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).agg(F.bool_or(F.col("l_returnflag") == "R").alias("r"), F.bool_or(F.col("l_returnflag") == "A").alias("x"))
    parts = F.array(F.lit("any"), F.when(F.col("r") & F.col("x"), "both"), F.when(F.col("r") & ~F.col("x"), "first"))
    return sides.select(F.explode(F.array_compact(parts)).alias("part"), "a", "b")


# --- graph and merge ---

_LINKS = f"""
    n AS (SELECT doc_id, {NORMAL.format("text")} AS nm FROM documents),
    g AS (SELECT nm, min(doc_id) AS root FROM n GROUP BY nm)"""


@query("connected_components", f"WITH {_LINKS} SELECT n.doc_id AS id, g.root AS component FROM n JOIN g USING (nm)")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of equal normalised text, linked in a chain by id."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalize_name(F.col("text"))).alias("key"))
    from pyspark.sql import Window

    before = F.lag("doc_id").over(Window.partitionBy("key").orderBy("doc_id"))
    edges = d.select(before.alias("src"), F.col("doc_id").alias("dst")).where("src IS NOT NULL")
    return graph.connected_components(d, edges, "doc_id")


def _part_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_brand", "p_type").alias("name"), F.col("p_type").alias("description"), "p_name")
    return entities.to_entities(p, "p_partkey", "name", ["description"], "part").withColumn("component", F.element_at("attributes", F.lit("p_name")))


_BEST = "arg_max({0}, ROW(length({0}), -er_id)) FILTER (WHERE {0} <> '')"


@query("merge_entities", f"""
    WITH e AS (SELECT p_partkey AS er_id, p_brand || ' ' || p_type AS name, p_type AS description, p_name AS component FROM part)
    SELECT component, min(er_id) AS er_id, {_BEST.format("name")} AS name, {_BEST.format("description")} AS description,
           array_to_string(list_filter(list(er_id ORDER BY er_id), lambda x, i: i > 1), ',') AS source_ids FROM e GROUP BY component""")  # fmt: skip
def merge_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = merge.merge_components(_part_entities(spark, sf_dir))
    return m.select("component", "er_id", "name", "description", F.coalesce(F.array_join(F.transform("source_ids", lambda x: x.cast("string")), ","), F.lit("")).alias("source_ids"))


@query("most_common", """
    WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL)
    SELECT p_brand, p_type AS p_type_common FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, length(p_type) DESC, p_type) AS rn FROM c) WHERE rn = 1""")  # fmt: skip
def most_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.most_common(table(spark, sf_dir, "part"), "p_brand", "p_type")


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_returnflag").alias("type"), "l_quantity", "l_extendedprice")


@query("edge_group", "SELECT l_partkey AS src, l_suppkey AS dst, l_returnflag AS type, count(*) AS group_size FROM lineitem GROUP BY ALL")
def edge_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.group_edges(_edges(spark, sf_dir))


@query("edge_merge", """
    SELECT l_partkey AS src, l_suppkey AS dst, l_returnflag AS type, sum(l_quantity) AS l_quantity, max(l_extendedprice) AS l_extendedprice, count(*) AS group_size
    FROM lineitem GROUP BY l_partkey, l_suppkey, l_returnflag""")  # fmt: skip
def edge_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.merge_edges(_edges(spark, sf_dir), sums=("l_quantity",), maxima=("l_extendedprice",))


@query("edge_remap", """
    WITH m AS (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_name) AS root FROM part)
    SELECT coalesce(m.root, l_partkey) AS src, l_suppkey AS dst, count(*) AS n FROM lineitem LEFT JOIN m ON l_partkey = m.p_partkey
    WHERE coalesce(m.root, l_partkey) <> l_suppkey GROUP BY ALL""")  # fmt: skip
def edge_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part ends go to the merged parts; supplier ends lie in another id space, moved out of the way."""
    ids = merge.id_map(merge.merge_components(_part_entities(spark, sf_dir)))
    far = 10**12
    moved = _edges(spark, sf_dir).select("src", (F.col("dst") + far).alias("dst"))
    out = merge.remap_edges(moved, ids).withColumn("dst", F.col("dst") - far)
    return out.where("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


# --- profile ---

_CUSTOMER = ("c_acctbal", "c_custkey", "c_mktsegment", "c_name", "c_nationkey")


@query("profile", " UNION ALL ".join(
    f"SELECT '{c}' AS field, round(count({c}) / count(*), 4) AS completeness, round(count(DISTINCT {c}) / count({c}), 4) AS uniqueness FROM customer" for c in _CUSTOMER))
def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.profile_columns(table(spark, sf_dir, "customer")).select("field", "completeness", "uniqueness")


@query("field_types", "SELECT * FROM (VALUES ('page_id', 'numeric'), ('url', 'url')) t(field, inferred_type)")
def field_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.profile_columns(table(spark, sf_dir, "pages").select("page_id", "url")).select("field", "inferred_type")


_LOOKS = {
    "email": r"regexp_matches(v, '^[^@\s]+@[^@\s]+[.][^@\s]+$')", "url": r"regexp_matches(v, '^(https?://|www\.)', 'i')", "date": r"regexp_matches(v, '^([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4})')",
    "phone": r"length(v) >= 7 AND regexp_matches(v, '^[\d\s().+-]+$')", "numeric": r"regexp_matches(v, '^[\d.,-]+$')", "name": r"length(v) < 100 AND length(regexp_replace(v, '[^\p{L}]', '', 'g')) >= length(v) * 0.5",
}


@query("field_type_votes", "WITH x AS (SELECT 'source' AS field, trim(source) AS v FROM documents UNION ALL SELECT 'url', trim(url) FROM pages UNION ALL SELECT 'props', trim(props) FROM events UNION ALL SELECT 'key', CAST(event_id AS VARCHAR) FROM events) SELECT field, "
       + ", ".join(f"count(*) FILTER (WHERE {c}) AS as_{k}" for k, c in _LOOKS.items()) + " FROM x GROUP BY field")
def field_type_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = (("documents", "source", "source"), ("pages", "url", "url"), ("events", "props", "props"), ("events", "event_id", "key"))
    x = None
    for name, column, field in columns:
        one = table(spark, sf_dir, name).select(F.lit(field).alias("field"), F.trim(F.col(column).cast("string")).alias("v"))
        x = one if x is None else x.unionByName(one)
    return x.groupBy("field").agg(*[F.count_if(c).alias(f"as_{k}") for k, c in votes(F.col("v")).items()])


@query("duplicate_rate", "SELECT round(1 - round(count(DISTINCT p_name) / count(*), 4), 6) AS estimated_duplicate_rate FROM part")
def duplicate_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = profiling.profile_columns(table(spark, sf_dir, "part").select(F.col("p_name").alias("name")))
    return profiling.duplicate_rate(p).select(F.round("estimated_duplicate_rate", 6).alias("estimated_duplicate_rate"))


# --- vectors ---


def _centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("label").cast("bigint").alias("centroid"), F.posexplode("embedding").alias("i", "x"))
    mean = e.groupBy("centroid", "i").agg(F.round(F.avg(F.col("x").cast("double")), 9).alias("m"))
    return mean.groupBy("centroid").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("center"))


_CENTROID_SQL = """
    c AS (SELECT centroid, list(m ORDER BY i) AS center FROM (SELECT label AS centroid, i, round(avg(CAST(embedding[i] AS DOUBLE)), 9) AS m
          FROM (SELECT label, embedding, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY label, i) GROUP BY centroid)"""


@query("centroid_assign", f"""
    WITH {_CENTROID_SQL}, s AS (SELECT vec_id, centroid, list_inner_product(CAST(embedding AS DOUBLE[]), center) AS s FROM embeddings, c)
    SELECT vec_id, CAST(arg_max(centroid, ROW(round(s, 9), -centroid)) AS BIGINT) AS centroid FROM s GROUP BY vec_id""")  # fmt: skip
def centroid_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.assign_nearest(table(spark, sf_dir, "embeddings"), _centroids(spark, sf_dir), "vec_id")


@query("cosine_in_block", """
    WITH s AS (SELECT *, floor((row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) / 100) AS salt FROM embeddings)
    SELECT x.vec_id, arg_max(y.vec_id, ROW(round(list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])), 6), -y.vec_id)) AS nearest
    FROM s x JOIN s y ON x.label = y.label AND x.salt = y.salt AND x.vec_id <> y.vec_id GROUP BY x.vec_id""")  # fmt: skip
def cosine_in_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest other vector of the same run of a hundred of a block, so work grows with the rows."""
    e = table(spark, sf_dir, "embeddings")
    runs = blocking.salt(blocking.key_blocks(e, F.col("label").cast("string"), "vec_id"), 100)
    held = e.join(runs, e["vec_id"] == runs["er_id"]).select("block_key", "salt_id", "vec_id", "embedding")
    x, y = (held.select("block_key", "salt_id", F.col("vec_id").alias(f"{n}_id"), F.col("embedding").alias(f"{n}_v")) for n in ("x", "y"))
    met = x.join(y, ["block_key", "salt_id"]).where("x_id <> y_id")
    return met.groupBy(F.col("x_id").alias("vec_id")).agg(F.max_by("y_id", F.struct(F.round(cosine(F.col("x_v"), F.col("y_v")), 6), -F.col("y_id"))).alias("nearest"))


@query("vector_cosine", f"""
    WITH {_CENTROID_SQL}
    SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), center), 6) AS cosine, round(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm,
           round(CAST(embedding[1] AS DOUBLE) / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS first_unit
    FROM embeddings JOIN c ON label = centroid""")  # fmt: skip
def vector_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector against its label's centroid."""
    e = table(spark, sf_dir, "embeddings").withColumn("centroid", F.col("label").cast("bigint")).join(_centroids(spark, sf_dir), "centroid")
    v = F.col("embedding")
    return e.select("vec_id", F.round(cosine(v, F.col("center")), 6).alias("cosine"), F.round(norm(v), 6).alias("norm"), F.round(l2_normalize(v)[0], 6).alias("first_unit"))


@query("vector_blocks")
def vector_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spherical k-means; not expressible in SQL."""
    return blocking.vector_blocks(table(spark, sf_dir, "embeddings"), "vec_id")


# --- lineage and report ---


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts merged by name, with rows of every seventh id lost and every eleventh skipped."""
    m = merge.merge_components(_part_entities(spark, sf_dir))
    reason = F.when(F.col("er_id") % 22 == 0, "error_recovery").when(F.col("er_id") % 33 == 0, "singleton_block")
    return m.withColumns({"match_skip": F.col("er_id") % 11 == 0, "match_skip_reason": reason})


@query("missing_recovery", """
    WITH g AS (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_name) AS root FROM part)
    SELECT p_partkey AS er_id FROM g WHERE root % 7 = 0""")  # fmt: skip
def missing_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    lost = merge.merge_components(_part_entities(spark, sf_dir)).where("er_id % 7 <> 0")
    return lineage.missing_ids(_part_entities(spark, sf_dir), lost)


@query("restore_lineage", """
    WITH g AS (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) - 1 AS l FROM part),
         h AS (SELECT p_name, min(p_partkey) AS er_id, array_to_string(list(p_partkey ORDER BY p_partkey) FILTER (WHERE l BETWEEN 1 AND 2), ',') AS source_ids FROM g GROUP BY p_name)
    SELECT er_id, coalesce(source_ids, '') AS source_ids, CAST(NULL AS VARCHAR) AS reason FROM h UNION ALL SELECT p_partkey, '', 'missing_in_match_output' FROM g WHERE l > 2""")  # fmt: skip
def restore_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A matcher that merges each block's first three rows and forgets the others."""
    rows = _part_entities(spark, sf_dir).withColumnRenamed("component", "block_key")
    asked = lineage.local_ids(rows, ["block_key"])
    answer = asked.where("local_id = 0").select("block_key", "local_id", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("description"), F.array(F.lit(1), F.lit(2)).cast("array<bigint>").alias("source_local"))
    out = lineage.restore(answer, rows, ["block_key"])
    return out.select("er_id", F.coalesce(F.array_join(F.transform("source_ids", lambda x: x.cast("string")), ","), F.lit("")).alias("source_ids"), F.col("match_skip_reason").alias("reason"))


@query("skip_reasons", """
    WITH m AS (SELECT min(p_partkey) AS id FROM part GROUP BY p_name)
    SELECT CASE WHEN id % 22 = 0 THEN 'error_recovery' WHEN id % 33 = 0 THEN 'singleton_block' ELSE 'unknown' END AS reason, count(*) AS n FROM m WHERE id % 11 = 0 GROUP BY 1""")  # fmt: skip
def skip_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.skip_reasons(_resolved(spark, sf_dir))


@query("uuid_coverage", """
    WITH g AS (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_name) AS root FROM part), s AS (SELECT p_partkey FROM g WHERE p_partkey <> root)
    SELECT count(*) AS total, count(*) FILTER (WHERE p_partkey % 5 <> 0) AS valid, count(*) FILTER (WHERE p_partkey % 5 = 0) AS invalid,
           round(100 * count(*) FILTER (WHERE p_partkey % 5 <> 0) / count(*), 6) AS coverage_pct, false AS passed FROM s""")  # fmt: skip
def uuid_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _part_entities(spark, sf_dir)
    c = metrics.uuid_coverage(merge.merge_components(rows), rows.where("er_id % 5 <> 0").select(F.col("er_uuid").alias("uuid")))
    return c.select("total", "valid", "invalid", F.round("coverage_pct", 6).alias("coverage_pct"), "passed")


@query("er_report", """
    WITH m AS (SELECT min(p_partkey) AS id, count(*) - 1 AS s FROM part GROUP BY p_name), t AS (SELECT count(*) AS n FROM part)
    SELECT count(*) AS unique_count, count(*) FILTER (WHERE id % 11 = 0) AS skipped, count(*) FILTER (WHERE id % 11 <> 0) AS processed,
           count(*) FILTER (WHERE id % 22 = 0) AS error_recovery, CAST(sum(s) AS BIGINT) AS source_ids, count(*) FILTER (WHERE s > 0) AS entities_with_merges,
           round(100 * (max(n) - count(*)) / max(n), 2) AS overall_reduction_pct,
           CASE WHEN 100 * count(*) FILTER (WHERE id % 22 = 0) / count(*) < 1 THEN 'PASS' ELSE 'FAIL' END AS status FROM m, t""")  # fmt: skip
def er_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    original = table(spark, sf_dir, "part").count()
    return metrics.er_report(_resolved(spark, sf_dir), original).select("unique_count", "skipped", "processed", "error_recovery", "source_ids", "entities_with_merges", "overall_reduction_pct", "status")


# --- the loop ---


@query("rule_match", """
    SELECT min(p_partkey) OVER (PARTITION BY p_name) AS entity_a_id, p_partkey AS entity_b_id, true AS is_match FROM part
    QUALIFY entity_a_id < entity_b_id""")  # fmt: skip
def rule_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal names are linked to the first row that has them."""
    rows = entities.to_entities(table(spark, sf_dir, "part"), "p_partkey", "p_name", [])
    blocks = blocking.salt(blocking.key_blocks(rows, T.normalize_name(F.col("name"))), 100)
    return matching.RuleMatcher()(rows, blocks).select("entity_a_id", "entity_b_id", "is_match")


_WORDS = "list_distinct(string_split({0}, ' '))"


@query("rule_match_similar", f"""
    WITH r AS (SELECT p_brand, p_name AS n, min(p_partkey) AS id FROM part GROUP BY ALL),
         s AS (SELECT least(x.id, y.id) AS a, greatest(x.id, y.id) AS b,
                      greatest(1 - levenshtein(x.n, y.n) / greatest(length(x.n), length(y.n)), len(list_intersect({_WORDS.format("x.n")}, {_WORDS.format("y.n")})) / len(list_distinct(list_concat({_WORDS.format("x.n")}, {_WORDS.format("y.n")})))) AS c
               FROM r x JOIN r y ON x.p_brand = y.p_brand AND x.n < y.n),
         e AS (SELECT min(p_partkey) OVER (PARTITION BY p_brand, p_name) AS a, p_partkey AS b, 1.0 AS c FROM part)
    SELECT a AS entity_a_id, b AS entity_b_id, round(c, 6) AS confidence FROM s WHERE c >= 0.85 UNION ALL SELECT a, b, c FROM e WHERE a < b""")  # fmt: skip
def rule_match_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of one brand with names that are alike at the production threshold: each two different
    names of a brand are compared, equal ones linked to their first row."""
    rows = entities.to_entities(table(spark, sf_dir, "part"), "p_partkey", "p_name", [])
    blocks = blocking.key_blocks(table(spark, sf_dir, "part"), F.col("p_brand"), "p_partkey")
    return matching.RuleMatcher(0.85)(rows, blocks).select("entity_a_id", "entity_b_id", F.round("confidence", 6).alias("confidence"))


def _resolved_documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list]:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalize_name(F.col("text"))).alias("name"))
    return resolve(docs, ResolveConfig(id_field="doc_id", name_field="name", text_fields=[], match_threshold=1.0))


@query("resolve_documents", f"WITH {_LINKS} SELECT root AS er_id, count(*) - 1 AS n_sources FROM n JOIN g USING (nm) GROUP BY root")
def resolve_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole loop: documents of equal normalised text become one entity with its lineage."""
    rows, _ = _resolved_documents(spark, sf_dir)
    return rows.select("er_id", F.size(F.coalesce("source_ids", F.array().cast("array<bigint>"))).cast("bigint").alias("n_sources"))


@query("resolve_rounds", f"""
    WITH {_LINKS}, t AS (SELECT (SELECT count(*) FROM n) AS a, (SELECT count(*) FROM g) AS b), k AS (SELECT unnest([1, 2]) AS iteration, a, b FROM t)
    SELECT iteration, CASE iteration WHEN 1 THEN a ELSE b END AS input_count, b AS output_count, round(CASE iteration WHEN 1 THEN 100.0 * (a - b) / a ELSE 0 END, 6) AS reduction_pct,
           round(100.0 * (a - b) / a, 6) AS overall_reduction_pct FROM k WHERE iteration = 1 OR 100.0 * (a - b) / a >= 1""")  # fmt: skip
def resolve_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each round did, until one shrinks the data by less than 1 %."""
    _, done = _resolved_documents(spark, sf_dir)
    found = [(r.iteration, r.input_count, r.output_count, round(r.reduction_pct, 6), round(r.overall_reduction_pct, 6)) for r in done]
    return spark.createDataFrame(found, "iteration int, input_count bigint, output_count bigint, reduction_pct double, overall_reduction_pct double")


@query("resolve_semantic", "SELECT min(c_custkey) AS er_id, c_mktsegment AS name, CAST(count(*) - 1 AS INTEGER) AS n_sources FROM customer GROUP BY c_mktsegment")
def resolve_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loop with vector blocks: equal segments have equal vectors, so each becomes one entity."""
    c = table(spark, sf_dir, "customer")
    rows, _ = resolve(c, ResolveConfig(id_field="c_custkey", name_field="c_mktsegment", text_fields=[], blocking_method="semantic", max_iterations=2))
    return rows.select("er_id", "name", F.size(F.coalesce("source_ids", F.array().cast("array<bigint>"))).alias("n_sources"))


@query("grouped_match", """
    WITH b AS (SELECT p_name, min(p_partkey) AS er_id, count(*) AS n FROM part GROUP BY p_name)
    SELECT b.er_id, p_brand || ' ' || p_type AS name, CASE WHEN n = 1 THEN 'singleton_block' END AS match_skip_reason, n - 1 AS n_sources FROM b JOIN part ON p_partkey = er_id""")  # fmt: skip
def grouped_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grouped function as the matcher: merges each block to its first row."""

    def first(pdf):  # noqa: ANN001, ANN202
        return [{"local_id": 0, "name": pdf["name"].iloc[0], "description": None, "source_local": list(range(1, len(pdf)))}]

    rows = _part_entities(spark, sf_dir).drop("component")
    out = matching.GroupedMatcher(first).resolve(rows, _part_blocks(spark, sf_dir))
    return out.select("er_id", "name", "match_skip_reason", F.size(F.coalesce("source_ids", F.array().cast("array<bigint>"))).cast("bigint").alias("n_sources"))


# --- files ---


def _folder(spark: SparkSession) -> str:
    """A new folder for a query's files, where all executors can read them."""
    return f"{shared_folder(spark)}/query-{uuid4().hex}"


@query("csv_round_trip", "SELECT s_suppkey, s_name || ', \"x\"' AS s_name, s_nationkey FROM supplier")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as CSV with quotes, read with types found out."""
    path = f"{_folder(spark)}/suppliers.csv"
    table(spark, sf_dir, "supplier").select("s_suppkey", F.concat("s_name", F.lit(', "x"')).alias("s_name"), "s_nationkey").write.option("header", True).option("escape", '"').csv(path)
    return files.load(spark, path).select(F.col("s_suppkey").cast("bigint"), "s_name", "s_nationkey")


@query("tsv_round_trip", "SELECT p_partkey, p_name, p_retailprice FROM part")
def tsv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{_folder(spark)}/parts.tsv"
    table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice").write.option("header", True).option("sep", "\t").csv(path)
    return files.load(spark, path, schema="p_partkey bigint, p_name string, p_retailprice double")


@query("blocks_round_trip", """
    SELECT p_name AS block_key, 'name' AS block_key_type, count(*) AS block_size, array_to_string(list(p_partkey ORDER BY p_partkey), ',') AS ids FROM part GROUP BY p_name""")  # fmt: skip
def blocks_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks with their entities as JSON lines, read again by their schema and checked for their columns."""
    path = f"{_folder(spark)}/blocks.jsonl"
    files.write_lines(blocking.nested(_part_entities(spark, sf_dir).select("er_id", "name"), _part_blocks(spark, sf_dir)), path)
    back = files.read_lines(spark, path, "block_key string, block_key_type string, entities array<struct<er_id: bigint, name: string>>, block_size bigint")
    ids = F.array_join(F.transform("entities", lambda e: e["er_id"].cast("string")), ",")
    return schema.require_columns(back).select("block_key", "block_key_type", "block_size", ids.alias("ids"))


@query("decisions_round_trip", "SELECT l_partkey AS entity_a_id, l_suppkey AS entity_b_id FROM lineitem WHERE l_returnflag = 'R'")
def decisions_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{_folder(spark)}/matches.jsonl"
    files.write_lines(match_decisions(spark, sf_dir), path)
    return files.read_decisions(spark, path).where("is_match").select("entity_a_id", "entity_b_id")


@query("truth_file", "SELECT DISTINCT l_partkey AS a, l_suppkey + 100000 AS b FROM lineitem WHERE l_linenumber = 1")
def truth_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled pairs of a CSV file, those with label 1."""
    path = f"{_folder(spark)}/test.csv"
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("ltable_id"), F.col("l_suppkey").alias("rtable_id"), (F.col("l_linenumber") == 1).cast("int").alias("label"))
    lines.write.option("header", True).csv(path)
    return files.read_truth(spark, path, offset=100_000)


@query("resolved_output", """
    SELECT p_name AS component, min(p_partkey) AS er_id, CASE WHEN count(*) > 1 THEN '[' || array_to_string(list(p_partkey ORDER BY p_partkey)[2:], ',') || ']' END AS source_ids, max(p_name) AS p_name FROM part GROUP BY p_name""")  # fmt: skip
def resolved_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities as they are delivered: attributes as columns, lists as JSON, a summary beside them."""
    folder = _folder(spark)
    files.write_output(merge.merge_components(_part_entities(spark, sf_dir)), folder)
    return spark.read.parquet(f"{folder}/resolved.parquet").select("component", F.col("er_id").cast("bigint"), "source_ids", "p_name")


@query("snapshots", "SELECT n_nationkey, n_name, 2 AS read_as FROM nation UNION ALL SELECT n_nationkey, n_name, 1 FROM nation WHERE n_regionkey = 1")
def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds' tables: the latest, and the first by its number."""
    folder, n = _folder(spark), table(spark, sf_dir, "nation")
    files.write_snapshot(n.where("n_regionkey = 1"), folder, 1)
    files.write_snapshot(n, folder, 2)
    latest, first = files.read_snapshot(spark, folder), files.read_snapshot(spark, folder, 1)
    return latest.select("n_nationkey", "n_name", F.lit(2).alias("read_as")).union(first.select("n_nationkey", "n_name", F.lit(1)))


_TWO = """
    l AS (SELECT CAST(c_custkey + 7 AS VARCHAR) AS id, CAST(row_number() OVER (ORDER BY c_custkey) - 1 AS BIGINT) AS pos FROM customer),
    r AS (SELECT CAST(s_suppkey + 3 AS VARCHAR) AS id, CAST(row_number() OVER (ORDER BY s_suppkey) - 1 AS BIGINT) + 100000 AS pos FROM supplier),
    m AS (SELECT CAST(o_custkey + 7 AS VARCHAR) AS a, CAST(l_suppkey + CASE l_linenumber WHEN 1 THEN 1000000 ELSE 3 END AS VARCHAR) AS b FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
    t AS (SELECT DISTINCT l.pos AS a, r.pos AS b FROM m JOIN l ON m.a = l.id JOIN r ON m.b = r.id)"""


def _two(spark: SparkSession, sf_dir: str) -> benchmarks.TwoTables:
    """Customers and suppliers as two tables, with the mapping that orders make; some ids are unknown."""
    left = entities.dense_id(table(spark, sf_dir, "customer").select((F.col("c_custkey") + 7).alias("id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("segment")), "pos", "id")
    right = entities.dense_id(table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 3).alias("id"), F.when(F.col("s_suppkey") % 5 > 0, F.col("s_name")).alias("title")), "pos", "id")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_suppkey") + F.when(F.col("l_linenumber") == 1, 1_000_000).otherwise(3)).alias("b"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") + 7).alias("a"))
    mapping = orders.join(lines, "l_orderkey").select("a", "b")
    return benchmarks.TwoTables("own", left, right, benchmarks.positions(mapping, left, right, "a", "b"))


@query("benchmark_truth", f"WITH {_TWO} SELECT a, b FROM t")
def benchmark_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mapping of string ids as pairs of positions; ids that a table lacks go."""
    return _two(spark, sf_dir).truth


@query("benchmark_entities", f"""
    WITH {_TWO}
    SELECT l.pos AS er_id, c_name AS name, c_mktsegment AS description FROM l JOIN customer ON CAST(c_custkey + 7 AS VARCHAR) = l.id
    UNION ALL SELECT r.pos, CASE WHEN s_suppkey % 5 > 0 THEN s_name ELSE r.id END, '' FROM r JOIN supplier ON CAST(s_suppkey + 3 AS VARCHAR) = r.id""")  # fmt: skip
def benchmark_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tables as entities; a row without a name takes its id."""
    return _two(spark, sf_dir).entities().select("er_id", "name", "description")


@query("benchmark_rates", f"""
    WITH {_TWO}, p AS (SELECT DISTINCT a, b FROM t WHERE a % 3 > 0 UNION SELECT DISTINCT pos, 100000 FROM l),
         c AS (SELECT (SELECT count(*) FROM p JOIN t USING (a, b)) AS tp, (SELECT count(*) FROM p) AS p, (SELECT count(*) FROM t) AS t) {_FROM_COUNTS}""")  # fmt: skip
def benchmark_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = _two(spark, sf_dir)
    found = data.truth.where("a % 3 > 0").union(data.left.select("pos", F.lit(100_000)))
    return _rounded(data.evaluate(found, cross_source_only=True))


@query("matched_right_rows", f"WITH {_TWO} SELECT DISTINCT b - 100000 AS pos FROM t")
def matched_right_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All right rows that have a match, whatever the sample's size."""
    return _two(spark, sf_dir).sample_right(0).select("pos")


# --- what else a run reports ---


@query("most_common_back", """
    WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL),
         b AS (SELECT p_brand, p_type FROM c QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, length(p_type) DESC, p_type) = 1)
    SELECT p_partkey, part.p_brand, b.p_type AS p_type_common FROM part LEFT JOIN b USING (p_brand)""")  # fmt: skip
def most_common_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.most_common(table(spark, sf_dir, "part"), "p_brand", "p_type", back=True).select("p_partkey", "p_brand", "p_type_common")


@query("entity_uuid", "SELECT p_partkey AS er_id, substr(sha256('part|' || CAST(p_partkey AS VARCHAR)), 1, 32) AS er_uuid FROM part")
def entity_uuid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part_entities(spark, sf_dir).select("er_id", "er_uuid")


@query("missing_uuids", """
    WITH g AS (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_name) AS root FROM part),
         u AS (SELECT DISTINCT substr(sha256('part|' || CAST(p_partkey AS VARCHAR)), 1, 32) AS uuid FROM g WHERE p_partkey <> root AND p_partkey % 5 = 0)
    SELECT uuid FROM u ORDER BY uuid LIMIT 10""")  # fmt: skip
def missing_uuids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten uuids that the history lacks: a report's sample."""
    rows = _part_entities(spark, sf_dir)
    c = metrics.uuid_coverage(merge.merge_components(rows), rows.where("er_id % 5 <> 0").select(F.col("er_uuid").alias("uuid")))
    return c.select(F.explode("missing").alias("uuid"))


@query("er_report_history", """
    WITH g AS (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_name) AS root FROM part), m AS (SELECT DISTINCT root AS id FROM g),
         s AS (SELECT count(*) AS n, count(*) FILTER (WHERE p_partkey % 5 = 0) AS bad FROM g WHERE p_partkey <> root), d AS (SELECT count(*) AS n FROM m WHERE id % 2 = 0), t AS (SELECT count(*) AS n FROM m)
    SELECT t.n + d.n AS raw_count, t.n AS unique_count, d.n AS duplicates, round(100.0 * d.n / (t.n + d.n), 6) AS duplicate_rate_pct, s.bad AS invalid_uuids,
           round(100.0 * (s.n - s.bad) / s.n, 6) AS coverage_pct, 'FAIL' AS status FROM s, d, t""")  # fmt: skip
def er_report_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With rows of even ids twice and a history that lacks every fifth id."""
    rows = _part_entities(spark, sf_dir)
    m = merge.merge_components(rows)
    out = metrics.er_report(m.unionByName(m.where("er_id % 2 = 0")), rows.count(), None, rows.where("er_id % 5 <> 0").select(F.col("er_uuid").alias("uuid")))
    return out.select("raw_count", "unique_count", "duplicates", F.round("duplicate_rate_pct", 6).alias("duplicate_rate_pct"), "invalid_uuids", F.round("coverage_pct", 6).alias("coverage_pct"), "status")


@query("match_totals", """
    WITH b AS (SELECT count(*) AS n FROM part GROUP BY p_name)
    SELECT CAST(sum(n) AS BIGINT) AS original_count, count(*) AS resolved_count, round(100.0 * (sum(n) - count(*)) / sum(n), 6) AS reduction_pct FROM b""")  # fmt: skip
def match_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = table(spark, sf_dir, "part").groupBy("p_name").agg(F.count(F.lit(1)).alias("original_count"), F.lit(1).cast("bigint").alias("resolved_count"))
    return files.match_totals(each).withColumn("reduction_pct", F.round("reduction_pct", 6))


@query("profile_samples", " UNION ALL ".join(
    f"SELECT '{c}' AS field, array_to_string((SELECT list(v ORDER BY v) FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM part ORDER BY v LIMIT 5)), ',') AS samples" for c in ("p_brand", "p_name", "p_partkey", "p_size", "p_type")))
def profile_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five values of each column."""
    p = profiling.profile_columns(table(spark, sf_dir, "part").select("p_brand", "p_name", "p_partkey", "p_size", "p_type"))
    return p.select("field", F.array_join("sample_values", ",").alias("samples"))


@query("parsed_edges", """
    SELECT l_orderkey, count(*) AS n_edges, round(sum(CASE WHEN l_orderkey % 3 = 0 THEN l_quantity ELSE -1 END), 6) AS weight FROM lineitem GROUP BY l_orderkey""")  # fmt: skip
def parsed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A resolver's JSON answers: lists for every third order, nothing usable for the others, whose
    own edges stay."""
    e = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_partkey").alias("dst"), F.col("l_quantity").alias("w"))).alias("new"))
    own = F.transform("new", lambda x: F.struct(x["dst"].alias("dst"), F.lit(-1.0).alias("w")))
    asked = e.select("l_orderkey", own.alias("own"), F.when(F.col("l_orderkey") % 3 == 0, F.to_json("new")).otherwise("sorry, no list").alias("answer"))
    out = merge.parsed_edges(asked, "answer", "array<struct<dst: bigint, w: double>>", "own")
    return out.select("l_orderkey", F.size("edges").cast("bigint").alias("n_edges"), F.round(F.aggregate("edges", F.lit(0.0), lambda s, x: s + x["w"]), 6).alias("weight"))


@query("edge_resolve", """
    SELECT l_orderkey AS src, l_suppkey % 10 AS dst, CASE WHEN count(*) > 1 THEN 'merged' ELSE min(l_returnflag) END AS type, count(*) AS n
    FROM lineitem GROUP BY l_orderkey, l_suppkey % 10""")  # fmt: skip
def edge_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of several edges go to a resolver's function, which merges each to one; others don't."""

    def each(pdf):  # noqa: ANN001, ANN202
        size = pdf.groupby("__group")["n"].transform("size")
        return pdf.assign(kind="merged", n=size).drop_duplicates("__group")

    e = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), (F.col("l_suppkey") % 10).alias("dst"), F.col("l_returnflag").alias("kind"), F.lit(1).cast("bigint").alias("n"))
    return merge.resolve_edges(e, each, "src bigint, dst bigint, kind string, n bigint", at_once=True).select("src", "dst", F.col("kind").alias("type"), "n")


@query("skip_split", """
    WITH m AS (SELECT min(p_partkey) AS id FROM part GROUP BY p_name) SELECT id AS er_id, id % 11 = 0 AS skipped FROM m""")  # fmt: skip
def skip_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir).select("er_id", F.coalesce("match_skip", F.lit(False)).alias("skipped"))


_DESCRIBED = [("er_id", "bigint", False), ("price", "double", True), ("tags", "array<string>", True), ("weights", "map<string,double>", True)]


@query("schema_builder", "SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{t}', {str(o).lower()})" for n, t, o in _DESCRIBED) + ") t(field, spark_type, optional)")
def schema_builder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Spark schema of an annotated class."""

    class Product:
        er_id: int
        price: float | None
        tags: list[str] | None
        weights: dict[str, float] | None

    Product.__annotations__ = {"er_id": int, "price": float | None, "tags": list[str] | None, "weights": dict[str, float] | None}
    return spark.createDataFrame([(f.name, f.dataType.simpleString(), f.nullable) for f in schema.schema_of(Product).fields], "field string, spark_type string, optional boolean")


@query("schema_widened", "SELECT * FROM (VALUES ('n_nationkey', 'bigint', 'int'), ('n_name', 'string', 'str'), ('n_regionkey', 'bigint', 'int')) t(field, spark_type, python_type)")
def schema_widened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table's schema with wide numbers, and how a matcher is told of it."""
    wide = schema.widen_ints(table(spark, sf_dir, "nation")).schema
    told = {d["field"]: d["type"].removesuffix(" | None") for d in schema.described(wide)}
    return spark.createDataFrame([(f.name, f.dataType.simpleString(), told[f.name]) for f in wide.fields], "field string, spark_type string, python_type string")


@query("config_bounds", "SELECT * FROM (VALUES (1, 5, 30, 100, 0.01), (2, 10, 200, 500, 0.01), (3, 3, 15, 50, 0.05)) t(n, max_iterations, target_block_size, max_block_size, convergence_threshold)")
def config_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings as given, beyond all bounds, and from nested YAML."""
    raw = [{"max_block_size": 100}, {"max_iterations": 99, "convergence_threshold": 0.9, "blocking": {"target_block_size": 999, "max_block_size": 9999}}, Settings({"a": {"n": 15}, "er": {"max_iterations": 3, "convergence_threshold": 0.05, "blocking": {"target_block_size": "${a.n}", "max_block_size": 50}}}).get("er")]
    made = [ResolveConfig.of(r) for r in raw]
    return spark.createDataFrame([(k + 1, c.max_iterations, c.target_block_size, c.max_block_size, float(c.convergence_threshold)) for k, c in enumerate(made)], "n int, max_iterations int, target_block_size int, max_block_size int, convergence_threshold double")


@query("suggested_config", "SELECT 'p_name' AS name_field, 'entity' AS entity_type, 5 AS max_iterations, CASE WHEN count(*) > 30 THEN 'semantic' ELSE 'name' END AS method, 30 AS target_block_size FROM part")
def suggested_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    c = profiling.suggested_config(profiling.profile_columns(p), p.count())
    return spark.createDataFrame([(c["name_field"], c["entity_type"], c["max_iterations"], c["blocking"]["method"], c["blocking"]["target_block_size"])], "name_field string, entity_type string, max_iterations int, method string, target_block_size int")


@query("block_targets", "SELECT i AS iteration, greatest(10, 30 // i) AS target FROM (SELECT unnest([1, 2, 3, 4]) AS i)")
def block_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(i, blocking.effective_target(30, i)) for i in (1, 2, 3, 4)], "iteration int, target int")


@query("summary_file", "SELECT count(*) AS original_count, count(DISTINCT p_name) AS final_count FROM part")
def summary_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's summary, written as JSON and read again."""
    path = f"{_folder(spark)}/summary.json"
    p = table(spark, sf_dir, "part")
    files.write_json(p.agg(F.count(F.lit(1)).alias("original_count"), F.countDistinct("p_name").alias("final_count")).first().asDict(), path, spark)
    return spark.read.option("multiLine", True).json(path).select("original_count", "final_count")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve_documents(spark, sf_dir)


