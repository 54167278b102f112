"""Configuration, files, the resolve loop, streaming, the command line, queries against SQL."""

import glob
import json
import os
import zipfile

import pytest

import __spark_entry__ as entry
from kinfold import cli, queries
from kinfold.plans.config import ResolveConfig, Settings, bounded, without_fence
from kinfold.plans.resolve import has_converged, report, resolve
from kinfold.sources import benchmarks, files
from kinfold.streaming.ingest import ingest

DATA = "/root/testdata/sf0.001"


def test_settings():
    s = Settings({"a": {"b": "x", "list": ["${a.b}", 1]}, "c": "${a.b}/y", "d": "${e}", "e": "${d}", "p": "it={n}", "num": 5, "same": "${num}"})
    assert s.get("c") == "x/y" and s.get("a.list") == ["x", 1] and s.get("no.such", 3) == 3 and s.get("p", n=4) == "it=4" and s.get("same") == 5
    with pytest.raises(ValueError, match="itself"):
        s.get("d")


def test_bounds():
    out = bounded({"max_iterations": 99, "convergence_threshold": 0.9, "blocking": {"max_block_size": 9999, "target_block_size": 999}})
    assert out["max_iterations"] == 10 and out["convergence_threshold"] == 0.01 and out["blocking"] == {"max_block_size": 500, "target_block_size": 200}
    assert bounded("text")["name_field"] == "name"
    assert without_fence("```yaml\na: 1\n```") == "a: 1"
    c = ResolveConfig.of({"name_field": "t", "blocking": {"method": "semantic", "target_block_size": 20}, "unknown": 1})
    assert (c.name_field, c.blocking_method, c.target_block_size) == ("t", "semantic", 20)


def test_convergence():
    assert has_converged(0.5, 0.01) and not has_converged(2.1, 0.01)


def test_formats(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('id,name\n1,"Caf\xe9, x"\n2,"two\nlines"\n'.encode("latin-1"))
    (tmp_path / "b.tsv").write_text("id\tname\n1\tÉté\n")
    (tmp_path / "c.csv").write_text("id,name\n1,has � itself\n2,é\n")
    assert [r.name for r in files.load(spark, f"{tmp_path}/a.csv").orderBy("id").collect()] == ["Café, x", "two\nlines"]
    assert files.load(spark, f"{tmp_path}/b.tsv").first().name == "Été"
    assert [r.name for r in files.load(spark, f"{tmp_path}/c.csv").orderBy("id").collect()] == ["has � itself", "é"]
    with pytest.raises(ValueError, match="unsupported"):
        files.load(spark, "x.xlsx")
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.write(tmp_path / "b.tsv", "inner/b.tsv")
    assert files.delimited_in_zip(spark, f"{tmp_path}/z.zip", "b.tsv", f"{tmp_path}/u", "\t").count() == 1
    with pytest.raises(FileNotFoundError):
        files.delimited_in_zip(spark, f"{tmp_path}/z.zip", "no.csv", f"{tmp_path}/u")


def test_snapshots(spark, tmp_path):
    for i in (1, 2):
        files.write_snapshot(spark.range(i), f"{tmp_path}/s", i)
    assert files.read_snapshot(spark, f"{tmp_path}/s", 1).count() == 1 and files.read_snapshot(spark, f"{tmp_path}/s").count() == 2
    assert "spark.sql.catalog.local" in files.iceberg_conf("/w")


def test_output(spark, tmp_path):
    rows, done = resolve(spark.createDataFrame([(1, "Acme Inc", "x"), (2, "acme inc", "longer"), (3, "Other", None)], "id long, name string, note string"))
    files.write_output(rows, f"{tmp_path}/o", {"n": 1})
    back = files.load(spark, f"{tmp_path}/o/resolved.parquet")
    assert back.count() == 2 and "note" in back.columns and "attr_name" in back.columns and dict(back.dtypes)["source_ids"] == "string"
    assert json.loads((tmp_path / "o/summary.json").read_text()) == {"n": 1}
    m = next(r for r in rows.collect() if r.source_ids)
    assert m.er_id == 0 and m.source_ids == [1] and m.description == "longer"
    assert done[0].input_count == 3 and done[0].output_count == 2 and done[-1].coverage_pct == 100.0
    assert report(rows, done).first().unique_count == 2


def test_loop_keeps_every_row_in_one_lineage(spark):
    names = [f"Company {i % 13} {'Inc.' * (i % 2)}" for i in range(80)]
    df = spark.createDataFrame(list(enumerate(names)), "key long, name string")
    rows, done = resolve(df, ResolveConfig(id_field="key", max_iterations=0, match_threshold=1.0))
    held = sorted(x for r in rows.collect() for x in [r.er_id, *(r.source_ids or [])])
    assert held == list(range(80)) and len(done) <= 20
    limited, _ = resolve(df, ResolveConfig(id_field="key", limit_blocks=1, max_iterations=1))
    assert sorted(x for r in limited.collect() for x in [r.er_id, *(r.source_ids or [])]) == list(range(80))


def test_two_table_benchmark(spark, tmp_path):
    (tmp_path / "tableA.csv").write_text("id,title\n0,Alpha beta\n1,Gamma\n")
    (tmp_path / "tableB.csv").write_text("id,title\n0,alpha Beta\n1,Delta\n2,Epsilon\n")
    (tmp_path / "train.csv").write_text("ltable_id,rtable_id,label\n0,0,1\n1,1,0\n")
    (tmp_path / "test.csv").write_text("ltable_id,rtable_id,label\n0,0,1\n")
    data = benchmarks.read(spark, "abt-buy", str(tmp_path))
    assert [tuple(r) for r in data.truth.collect()] == [(0, 100_000)]
    assert sorted(r.er_id for r in data.entities().collect()) == [0, 1, 100_000, 100_001, 100_002]
    assert data.sample_right(2).count() == 2 and data.sample_right(0).count() == 1
    out = cli.main(["benchmark", "--input", str(tmp_path), "--name", "abt-buy", "--output", f"{tmp_path}/r.json"])
    assert out["f1_score"] == 1.0
    with pytest.raises(FileNotFoundError):
        benchmarks.read(spark, "abt-buy", f"{tmp_path}/none")


def test_archived_benchmark(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "data.zip", "w") as z:
        z.writestr("Abt.csv", "id,name\n10,a\n20,b\n")
        z.writestr("Buy.csv", "id,name\n7,a\n")
        z.writestr("abt_buy_perfectMapping.csv", "idAbt,idBuy\n20,7\n99,7\n")
    data = benchmarks.read(spark, "abt-buy", str(tmp_path))
    b = {r.id: r.pos for r in data.left.collect()}
    assert [tuple(r) for r in data.truth.collect()] == [(b[20], 100_000)]


def test_command_line(spark, tmp_path):
    (tmp_path / "in.csv").write_text("id,name,city\n1,Acme Inc,X\n2,ACME inc,Yy\n3,Zed,Q\n")
    src = f"{tmp_path}/in.csv"
    assert cli.main(["run", "--input", src, "--output", f"{tmp_path}/run", "--iterations", "2"])["final_count"] == 2
    assert cli.main(["analyze", "--input", src])["rows"] == 3
    out = cli.main(["resolve", "--input", src, "--output", f"{tmp_path}/steps", "--method", "name"])
    assert out["match"]["resolved_count"] == 2 and out["eval"]["unique_count"] == 2
    (tmp_path / "e.csv").write_text("src,dst,type,w\n1,2,t,1.5\n1,2,t,2.5\n")
    assert cli.main(["edges", "--input", f"{tmp_path}/e.csv", "--output", f"{tmp_path}/e"]) == {"groups": 1, "edges": 2}


def test_incremental_pairs(spark, tmp_path):
    schema = "er_id long, name string"
    for k, rows in enumerate(([(1, "Acme Inc"), (2, "Zed")], [(3, "acme inc"), (4, "ACME Inc.")])):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        ingest(stream, f"{tmp_path}/index", f"{tmp_path}/pairs", f"{tmp_path}/check").awaitTermination()
        got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/pairs").select("a", "b").collect()))
        assert got == ([] if k == 0 else [(1, 3), (1, 4), (3, 4)])


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(frame):
    def one(v):
        if v is None or v != v:
            return None
        return round(float(v), 6) if isinstance(v, float) else str(v)

    return sorted(([one(v) for v in r] for r in frame[sorted(frame.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_equal_their_sql(spark, duck, name):
    a, b = queries.QUERIES[name](spark, DATA).toPandas(), duck.sql(queries.SQL[name]).df()
    assert sorted(a.columns) == sorted(b.columns) and plain(a) == plain(b)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_queries_without_sql_run(spark, name):
    assert queries.QUERIES[name](spark, DATA).count() > 0


def test_every_query_is_registered_once():
    q = entry.queries()
    assert set(entry.oracle_sql()) <= set(q) and set(queries.QUERIES) <= set(q)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_semantic_loop_at_every_block_count(spark):
    """Around one block's size: no row is lost and equal names always meet."""
    for n in (1, 30, 31, 59, 60):
        df = spark.createDataFrame([(i, f"name {i % 7}") for i in range(n)], "key long, name string")
        rows, _ = resolve(df, ResolveConfig(id_field="key", blocking_method="semantic", max_iterations=1, match_threshold=1.0))
        held = sorted(x for r in rows.collect() for x in [r.er_id, *(r.source_ids or [])])
        assert held == list(range(n)) and rows.count() == min(n, 7)


def test_all_benchmarks_and_download(spark, tmp_path):
    for name in ("abt-buy", "dblp-acm"):
        (tmp_path / name).mkdir()
    with zipfile.ZipFile(tmp_path / "away.zip", "w") as z:
        z.writestr("Abt.csv", "id,name\n10,a\n20,b\n")
        z.writestr("Buy.csv", "id,name\n7,a\n")
        z.writestr("abt_buy_perfectMapping.csv", "idAbt,idBuy\n10,7\n")
    url = (tmp_path / "away.zip").as_uri()
    for _ in range(2):  # the second time it is there already
        assert cli.main(["download", "--input", url, "--name", "abt-buy", "--output", f"{tmp_path}/abt-buy"]) == {"dataset": "abt-buy", "left": 2, "right": 1, "pairs": 1}
    out = cli.main(["benchmark-all", "--input", str(tmp_path), "--output", f"{tmp_path}/out"])
    assert out["abt-buy"]["f1_score"] == 1.0 and "error" in out["dblp-acm"]
    assert set(json.loads((tmp_path / "out/all_results.json").read_text())) == {"abt-buy", "dblp-acm"}
    with pytest.raises(ValueError, match="unknown"):
        benchmarks.fetch("no-such", str(tmp_path), url)


def test_names_of_two_tables(spark):
    from kinfold.operators.entities import two_tables

    left = spark.createDataFrame([(0, "L1", "a"), (1, None, None), (2, "L3", "")], "pos long, id string, title string")
    got = {r.er_id: r.name for r in two_tables(left, left.drop("id"), "pos", name="title").collect()}
    assert got == {0: "a", 1: "unknown", 2: "unknown", 100_000: "a", 100_001: "unknown", 100_002: "unknown"}
    named = spark.createDataFrame([(0, "L1", None)], "pos long, id string, title string")
    assert two_tables(named, named, "pos", name="title").first().name == "L1"


def test_control_by_rule_and_by_choice(spark):
    from kinfold.plans.controller import control

    df = spark.createDataFrame([(f"Name {i % 5}", i) for i in range(40)], "title string, n long")
    state = control(df, config=ResolveConfig(name_field="title", text_fields=[], match_threshold=1.0))
    assert state["counts"] == [40, 5, 5] and state["steps"] == ["prepare", "block", "match", "block", "match"]
    seen = []
    control(df, {"look": lambda s: seen.append(s["table"].count())}, lambda s: "finish" if seen else "look")
    assert seen == [40]
    with pytest.raises(ValueError, match="no tool"):
        control(df, decide=lambda s: "fly")
    with pytest.raises(RuntimeError):
        control(df, {"wait": lambda s: None}, lambda s: "wait", most_steps=3)


def test_embedding_counts_trigrams_and_rows_are_spread(spark):
    """the trigrams were worked out anew for each dimension, and a small file's rows all in one task."""
    import pyspark.sql.functions as F

    from kinfold.plans.resolve import hashed_embedding, spread

    names = ["", "ab", "AUTOMOBILE", "Ä b  ü", "aaaaaaaa"]
    rows = spark.createDataFrame([(i, n, {}) for i, n in enumerate(names)], "er_id long, name string, attributes map<string,string>")
    got = {r.er_id: r.embedding for r in hashed_embedding(rows).collect()}
    for i, n in enumerate(names):
        grams = [n.lower()[k : k + 3] for k in range(max(1, len(n) - 2))]
        want = [0.0] * 64
        for (h,) in spark.createDataFrame([(g,) for g in grams], "g string").select(F.xxhash64("g")).collect():
            want[h % 64] += 1.0 if h > 0 else -1.0
        assert got[i] == want
    parts = lambda df: df.select(F.spark_partition_id().alias("p")).distinct().count()
    many = spark.range(1000).withColumnRenamed("id", "er_id").coalesce(1)
    assert (parts(many), parts(spread(many)), parts(spread(many, 100))) == (1, spark.sparkContext.defaultParallelism, 10)
