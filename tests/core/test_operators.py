"""Blocks, pairs, metrics, graph, merge, lineage, matching."""

import json
import random

import pytest
import pyspark.sql.functions as F
import pyspark.sql.types as T

from kinfold.operators import blocking, entities, graph, lineage, matching, merge, metrics, pairs, prompts
from kinfold.operators.schema import ENVELOPE, conform


def envelope(spark, rows):
    names = [f.name for f in ENVELOPE.fields]
    full = [tuple({"name": f"n{r['er_id']}", "description": "", "er_uuid": f"u{r['er_id']}", **r}.get(n) for n in names) for r in rows]
    return spark.createDataFrame(full, ENVELOPE)


def blocks(spark, sizes):
    rows, i = [], 0
    for key, n in sizes.items():
        for _ in range(n):
            rows.append((i, key, n))
            i += 1
    return spark.createDataFrame(rows, "er_id long, block_key string, block_size int")


@pytest.mark.parametrize(("sizes", "most", "want"), [({"a": 3}, 10, {"a": {0}}), ({"a": 20}, 5, {"a": {0, 1, 2, 3}}), ({"a": 2, "b": 10}, 5, {"a": {0}, "b": {0, 1}})])
def test_salt(spark, sizes, most, want):
    got = {}
    for r in blocking.salt(blocks(spark, sizes), most).collect():
        got.setdefault(r.block_key, set()).add(r.salt_id)
    assert got == want


def test_effective_target():
    assert blocking.effective_target(50, 3) == 16 and blocking.effective_target(20, 10) == 10


def test_vector_blocks_partition_the_rows(spark):
    r = random.Random(0)
    df = spark.createDataFrame([(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(100)], "er_id long, embedding array<double>")
    got = blocking.vector_blocks(df, target=10).collect()
    assert sorted(x.er_id for x in got) == list(range(100)) and len({x.block_key for x in got}) > 1 and all(x.block_key.startswith("block_") for x in got)
    assert {x.block_key for x in blocking.vector_blocks(df, target=200).collect()} == {"block_0"}
    assert blocking.vector_blocks(df.limit(0)).count() == 0


def test_key_blocks_skip_null_and_empty(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, "")], "er_id long, k string")
    assert sorted(map(tuple, blocking.key_blocks(df, F.col("k")).collect())) == [(1, "a", 2), (2, "a", 2)]


def test_blocking_stats_of_nothing(spark):
    s = blocking.blocking_stats(blocks(spark, {"x": 1}).limit(0)).first()
    assert (s.total_blocks, s.total_entities, s.reduction_ratio) == (0, 0, 0.0)


def test_block_limit_loses_nothing(spark):
    b = blocks(spark, {"a": 2, "b": 3, "c": 1})
    assert blocking.first_blocks(b, 2).count() + blocking.other_blocks(b, 2).count() == 6
    assert {r.block_key for r in blocking.first_blocks(b, 2).collect()} == {"a", "b"}


def test_nested_blocks(spark):
    rows = envelope(spark, [{"er_id": i} for i in range(3)])
    n = blocking.nested(rows, blocks(spark, {"a": 3}))
    from kinfold.operators.schema import require_columns

    assert [e.er_id for e in require_columns(n).first().entities] == [0, 1, 2]


def ps(spark, values):
    return spark.createDataFrame(values, "a long, b long")


@pytest.mark.parametrize(
    ("p", "t", "want"),
    [([], [(1, 2)], (0.0, 0.0, 0.0)), ([(1, 2)], [], (0.0, 0.0, 0.0)), ([], [], (0.0, 0.0, 0.0)), ([(2, 1), (1, 2), (3, 4)], [(1, 2), (5, 6)], (0.5, 0.5, 0.5))],
)
def test_pair_metrics(spark, p, t, want):
    m = metrics.pair_metrics(ps(spark, p), ps(spark, t)).first()
    assert (m.precision, m.recall, m.f1_score) == want


def test_cross_source_pairs_only(spark):
    m = metrics.pair_metrics(ps(spark, [(1, 2), (1, 100_001)]), ps(spark, [(1, 100_001)]), cross_source_only=True).first()
    assert m.precision == 1.0


def test_pair_completeness(spark):
    assert metrics.pair_completeness(ps(spark, [(2, 1)]), ps(spark, [(1, 2), (3, 4)])).first()[0] == 0.5
    assert metrics.pair_completeness(ps(spark, [(2, 1)]), ps(spark, [])).first()[0] == 0.0


def clusters(spark, groups):
    return spark.createDataFrame([(k, e) for k, g in enumerate(groups) for e in g], "cluster_id long, entity_id long")


@pytest.mark.parametrize(("p", "t"), [([[1, 2, 3], [4, 5]], [[1, 2, 3], [4, 5]]), ([[1, 2], [3, 4]], [[5, 6], [7, 8]]), ([[1, 2, 3]], [[1, 2, 4]]), ([[1, 2, 3, 4], [5]], [[1, 2], [3, 4, 5]])])
def test_cluster_metrics_equal_those_of_pairs(spark, p, t):
    a, b = clusters(spark, p), clusters(spark, t)
    assert metrics.cluster_metrics(a, b).first() == metrics.overlapping_cluster_metrics(a, b).first()


def test_components(spark):
    v = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 6)], "id long")
    e = spark.createDataFrame([(1, 2), (3, 2), (4, 5), (5, 99), (6, 6), (None, 1)], "src long, dst long")
    assert {r.id: r.component for r in graph.connected_components(v, e).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6}
    assert {r.component for r in graph.connected_components(v, e.limit(0)).collect()} == {1, 2, 3, 4, 5, 6}


def test_components_of_random_graphs_and_a_chain(spark):
    r = random.Random(2)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 400)]
    root = {i: i for i in range(401)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = graph.connected_components(spark.range(401), spark.createDataFrame(edges, "src long, dst long"))
    assert {r.id: r.component for r in got.collect()} == {i: find(i) for i in root}


def fold(rows):
    """The merge by its definition: a left fold by ascending id."""
    rows = sorted(rows, key=lambda r: r["er_id"])
    m = {**rows[0], "source_ids": [s for s in rows[0].get("source_ids") or []]}
    for o in rows[1:]:
        for f in ("name", "description"):
            if len(o[f]) > len(m[f]):
                m[f] = o[f]
        m["source_ids"] += [o["er_id"], *(o.get("source_ids") or [])]
    m["source_ids"] = [x for x in dict.fromkeys(m["source_ids"]) if x != m["er_id"]]
    return m


def test_merge_like_a_fold(spark):
    r = random.Random(1)
    rows = [{"er_id": i, "name": "x" * r.randrange(4) + r.choice("abc"), "description": r.choice(["", "d", "dd"]), "source_ids": r.choice([None, [r.randrange(60)], [500 + i, 3]])} for i in range(60)]
    group = {x["er_id"]: r.randrange(15) for x in rows}
    df = envelope(spark, rows).withColumn("component", F.element_at(F.create_map(*[F.lit(v) for kv in group.items() for v in kv]), F.col("er_id").cast("int")))
    for got in merge.merge_components(df.repartition(5)).collect():
        want = fold([x for x in rows if group[x["er_id"]] == got.component])
        assert (got.er_id, got.name, got.description, got.source_ids or []) == (want["er_id"], want["name"], want["description"], want["source_ids"])
        assert got.er_uuid == f"u{got.er_id}" and got.er_uuid not in (got.source_uuids or [])


def test_merge_attributes_and_skip_fields(spark):
    rows = [{"er_id": 1, "attributes": {"a": "x", "b": ""}, "match_skip": True, "match_skip_reason": "r"}, {"er_id": 2, "attributes": {"a": "longer", "c": None}}]
    m = merge.merge_components(envelope(spark, rows).withColumn("component", F.lit(1))).first()
    assert m.attributes == {"a": "longer", "b": "", "c": None} and m.match_skip and m.match_skip_reason == "r" and m.source_ids == [2]


def test_merging_twice_changes_nothing(spark):
    df = envelope(spark, [{"er_id": i, "name": "n" * i} for i in range(1, 4)]).withColumn("component", F.lit(1))
    one = merge.merge_components(df)
    assert merge.merge_components(one).collect() == one.collect()


def test_most_common(spark):
    df = spark.createDataFrame([("g", "a"), ("g", "bb"), ("g", "cc"), ("h", "x"), ("h", "x"), ("h", "yyy"), ("i", None), (None, "q")], "g string, v string")
    assert {r.g: r.v_common for r in merge.most_common(df, "g", "v").collect()} == {"g": "bb", "h": "x", None: "q"}
    back = merge.most_common(df, "g", "v", back=True).collect()
    assert len(back) == 8 and {r.v_common for r in back if r.g is None} == {None}


def test_edges(spark):
    e = spark.createDataFrame([(1, 2, "t", 1.0, "a"), (1, 2, "t", 2.0, "bb"), (1, 3, None, 5.0, "")], "src_id long, dst_id long, edge_type string, weight double, note string")
    assert sorted(r.group_size for r in merge.group_edges(e).collect()) == [1, 2]
    m = {r.dst: r for r in merge.merge_edges(e, sums=("weight",), texts=("note",)).collect()}
    assert m[2].weight == 3.0 and m[2].note == "bb" and m[3].type == ""
    edges = spark.createDataFrame([(1, 2, "x"), (2, 3, "y"), (4, 5, "z")], "src long, dst long, type string")
    ids = spark.createDataFrame([(2, 1), (5, 4)], "old_id long, new_id long")
    assert sorted(map(tuple, merge.remap_edges(edges, ids).collect())) == [(1, 3, "y")]
    assert merge.remap_edges(edges, ids, drop_loops=False).count() == 3


def test_edge_resolver_failures_pass_through(spark):
    e = spark.createDataFrame([(1, 2, "t", 1.0), (1, 2, "t", 2.0), (5, 6, "t", 3.0), (7, 8, "bad", 1.0), (7, 8, "bad", 2.0)], "src long, dst long, type string, w double")

    def one(pdf):
        if (pdf["type"] == "bad").any():
            raise RuntimeError("no")
        return pdf.head(1)

    assert sorted((r.src, r.w) for r in merge.resolve_edges(e, one, "src long, dst long, type string, w double").collect()) == [(1, 1.0), (5, 3.0), (7, 1.0), (7, 2.0)]
    parsed = spark.createDataFrame([("[1,2]", [9]), ("nope", [9])], "j string, o array<int>")
    assert [r.edges for r in merge.parsed_edges(parsed, "j", "array<int>", "o").collect()] == [[1, 2], [9]]


def test_edge_resolver_takes_many_groups_at_once(spark):
    """a transfer to Python and back for each group took too long for millions of them."""
    schema = "src long, dst long, type string, w long, ok boolean"
    big = 2**60 + 1
    rows = [(i, i, "t", w, True) for i in range(50) for w in (big, big + 2)] + [(99, 9, "t", None, None), (99, 9, "t", 1, True)] + [(None, 9, "t", j, False) for j in range(40)]
    e = spark.createDataFrame(rows, schema).repartition(3)

    def seen(pdf):
        if (pdf["src"] == 7).any():
            raise RuntimeError("no")
        n = pdf.groupby("__group")["w"].transform("size")
        return pdf.assign(dst=pdf["__group"].nunique(), w=n).drop_duplicates("__group")[pdf["src"] != 8]

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = merge.resolve_edges(e, seen, schema, at_once=True).collect()
        alone = merge.resolve_edges(e, lambda pdf: pdf.iloc[::-1].head(len(pdf) if pdf["w"].dtype == "int64" else 1), schema).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    by = {}
    for r in got:
        by.setdefault(r.src, []).append(r)
    assert set(by) == {*range(50), 99, None}
    assert [sorted((r.w, r.ok) for r in by[i]) for i in (7, 8)] == [[(big, True), (big + 2, True)]] * 2
    assert all([r.w for r in by[i]] == [40 if i is None else 2] for i in by if i not in (7, 8))
    assert max(r.dst for i in by if i not in (7, 8) for r in by[i]) > 1
    assert sorted(((r.src or -1, r.w) for r in alone if r.src != 99), key=str) == sorted(((s or -1, w) for s, _, _, w, _ in rows if s != 99), key=str)
    assert len([r for r in alone if r.src == 99]) == 1


def test_pairs_go_to_many_tasks_before_they_are_combined(spark):
    """a task's memory grew with the part of a file that it read."""
    pairs_ = ps(spark, [(1, 2), (2, 1), (1, 2)])
    for found in (metrics.pair_metrics(pairs_, pairs_), metrics.pair_completeness(pairs_, pairs_)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_NUM" in plan and "200)" in plan and plan.count("hashpartitioning(a") == plan.count("hashpartitioning(a#") == 1
    assert metrics.pair_completeness(pairs_, ps(spark, [(2, 1), (3, 4)])).first()[0] == 0.5


def test_rates_of_tables_that_share_ids(spark):
    """with over 100,000 left rows, pairs were turned round or dropped, as their ids reach the right ones."""
    from kinfold.sources.benchmarks import TwoTables

    def rates(n, predicted, truth, **how):
        left, right = spark.range(n).toDF("pos"), spark.range(50_010).toDF("pos")
        r = TwoTables("t", left, right, ps(spark, truth)).evaluate(ps(spark, predicted), **how).first()
        return r.true_positives, r.false_positives, r.false_negatives

    truth = [(150_000, 100_005), (100_005, 150_000), (100_000, 100_000), (3, 100_001)]
    for how in ({}, {"cross_source_only": True}):
        assert rates(200_000, [*truth, (100_001, 3), (120_000, 100_000)], truth, **how) == (4, 1, 0)
    assert rates(200_000, truth[1:2], truth) == (1, 0, 3)
    inside = [(1, 2), (2, 1), (100_001, 100_002), (5, 5), (100_001, 3)]
    assert rates(10, inside, [(3, 100_001)]) == (1, 2, 0)
    assert rates(10, inside, [(3, 100_001)], cross_source_only=True) == (1, 0, 0)


def answers(spark, rows):
    return spark.createDataFrame(rows, "block_key string, local_id long, name string, description string, source_local array<long>")


def test_restore_and_recover(spark):
    rows = envelope(spark, [{"er_id": i, "source_ids": [i + 1], "source_uuids": [f"s{i}"]} for i in (100, 200, 300)]).withColumn("block_key", F.lit("b"))
    local = lineage.local_ids(rows, ["block_key"]).orderBy("er_id").collect()
    assert [r.local_id for r in local] == [0, 1, 2] and all(r.source_ids is None and r.source_uuids is None for r in local)
    out = {r.er_id: r for r in lineage.restore(answers(spark, [("b", 0, "best", None, [1, 77])]), rows, ["block_key"], 3).collect()}
    assert out[100].name == "best" and out[100].source_ids == [200, 201, 101] and out[100].source_uuids == ["u200", "s200", "s100"]
    assert set(out) == {100, 300} and out[300].match_skip_reason == lineage.MISSING and out[300].match_skip_history == [3]
    d = spark.createDataFrame([("b", 0, 1, True), ("b", 0, 9, True)], "block_key string, entity_a_id long, entity_b_id long, is_match boolean")
    assert sorted((r.entity_a_id, r.entity_b_id) for r in lineage.restore_decisions(d, rows, ["block_key"]).collect()) == [(0, 9), (100, 200)]
    assert [r.er_id for r in lineage.missing_ids(rows, rows.where("er_id = 100").withColumn("source_ids", F.array(F.lit(200)).cast("array<long>"))).collect()] == [300]


def test_grouped_matcher_contract(spark):
    rows = envelope(spark, [{"er_id": i} for i in range(7)])
    b = spark.createDataFrame([(0, "a", 3), (1, "a", 3), (2, "a", 3), (3, "bad", 2), (4, "bad", 2), (5, "one", 1)], "er_id long, block_key string, block_size int")

    def f(pdf):
        if "n3" in set(pdf["name"]):
            raise RuntimeError("offline")
        return [{"local_id": 0, "name": "merged", "description": None, "source_local": [1]}]

    out = {r.er_id: r for r in matching.GroupedMatcher(f).resolve(rows, b, 2).collect()}
    assert out[0].name == "merged" and out[0].source_ids == [1] and out[2].match_skip_reason == lineage.MISSING
    assert {out[i].match_skip_reason for i in (3, 4)} == {lineage.ERROR} and {out[i].match_skip_reason for i in (5, 6)} == {lineage.SINGLETON}
    held = sorted(x for r in out.values() for x in [r.er_id, *(r.source_ids or [])])
    assert held == list(range(7))


def test_rule_matcher(spark):
    rows = envelope(spark, [{"er_id": 1, "name": "Acme Widgets"}, {"er_id": 2, "name": "ACME widget"}, {"er_id": 3, "name": "Zebra"}, {"er_id": 4, "name": None}, {"er_id": 5, "name": "y" * 900}, {"er_id": 6, "name": "y" * 900}])
    b = blocking.key_blocks(rows, F.lit("all"))
    assert sorted((r.entity_a_id, r.entity_b_id) for r in matching.RuleMatcher(0.8)(rows, b).collect()) == [(1, 2), (5, 6)]


def report_rows(spark):
    return envelope(spark, [{"er_id": 1}, {"er_id": 1}, *[{"er_id": i, "match_skip": True, "match_skip_reason": r} for i, r in ((2, "error_recovery"), (3, "singleton_block"), (4, "missing_in_match_output"))]])


def test_report(spark):
    r = metrics.er_report(report_rows(spark), 100, 4).first()
    assert (r.raw_count, r.unique_count, r.duplicates, r.skipped, r.processed) == (5, 4, 1, 3, 1)
    assert (r.error_recovery, r.singleton_block, r.missing_in_match_output, r.unknown, r.other) == (1, 1, 1, 0, 0)
    assert r.overall_reduction_pct == 96.0 and r.iteration_reduction_pct == 0.0 and r.status == "FAIL" and r.coverage_passed
    assert "unique_count" in metrics.format_report(r.asDict())
    one = metrics.er_report(envelope(spark, [{"er_id": 1}]), 100, 4).first()
    assert one.overall_reduction_pct == 99.0 and one.status == "PASS"
    assert {x.reason: x.n for x in metrics.skip_reasons(envelope(spark, [{"er_id": 1, "match_skip": True}])).collect()} == {"unknown": 1}


def test_uuid_coverage(spark):
    h = spark.createDataFrame([("u1",), ("u2",), ("u3",)], "uuid string")
    ok = metrics.uuid_coverage(envelope(spark, [{"er_id": 1, "source_uuids": ["u2", "u3"]}]), h).first()
    assert ok.coverage_pct == 100.0 and ok.passed
    bad = metrics.uuid_coverage(envelope(spark, [{"er_id": 1, "source_uuids": ["u2", "unknown"]}]), h).first()
    assert bad.invalid == 1 and bad.missing == ["unknown"] and not bad.passed
    assert metrics.uuid_coverage(envelope(spark, [{"er_id": 1}]), h).first().coverage_pct == 100.0


def test_pairs_of_lineage_and_decisions(spark):
    e = envelope(spark, [{"er_id": 1, "source_ids": [2, 3]}])
    d = spark.createDataFrame([(5, 4, True), (6, 7, False)], "entity_a_id long, entity_b_id long, is_match boolean")
    assert sorted(map(tuple, pairs.predicted(d, e).collect())) == [(1, 2), (1, 3), (4, 5)]
    assert sorted(r.entity_id for r in pairs.clusters_of(e).collect()) == [1, 2, 3]


def test_entities(spark):
    df = spark.createDataFrame([(1, "A", "x", None, float("nan")), (2, None, None, "z", 2.0)], "id long, Title string, note string, more string, n double")
    assert entities.name_column(df) == "Title" and entities.text_columns(df, "Title") == ["note", "more"]
    e = {r.er_id: r for r in entities.to_entities(df, "id").collect()}
    assert e[1].name == "A" and e[2].name == "entity_2" and e[1].description == "x" and e[1].attributes == {"Title": "A", "note": "x"} and e[2].attributes == {"more": "z", "n": "2.0"}
    shown = conform(envelope(spark, [{"er_id": 1, "name": "N", "attributes": {"location": "L", "empty": ""}}]), ENVELOPE)
    assert shown.select(entities.embedding_text(["location", "empty", "none"]).alias("t")).first().t == "N L"


def test_dense_ids(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")).repartition(6)
    got = entities.dense_id(df, order="k").collect()
    assert sorted(r.er_id for r in got) == list(range(1000)) and all(r.er_id == r.k for r in got)
    assert sorted(r.er_id for r in entities.dense_id(df, start=5).collect()) == list(range(5, 1005))
    assert entities.dense_id(df.limit(0)).count() == 0


def test_equal_names_cost_as_many_pairs_as_rows(spark):
    rows = entities.to_entities(spark.createDataFrame([(i, "Same Name" if i % 3 else f"other {i}") for i in range(300)], "id long, name string"), "id", "name", [])
    blocks = blocking.salt(blocking.with_size(rows.select("er_id", F.lit("one").alias("block_key"))), 50)
    got = matching.RuleMatcher(0.99)(rows, blocks).collect()
    assert sorted((r.entity_a_id, r.entity_b_id) for r in got) == [(1, i) for i in range(2, 300) if i % 3]


def test_long_names_are_compared_whole(spark):
    base = "word " * 200
    data = [(1, base + "a"), (2, base + "b"), (3, "x" * 651 + "a"), (4, "x" * 651 + "b"), (5, "y" * 651), (6, ""), (7, None)]
    rows = entities.to_entities(spark.createDataFrame(data, "id long, name string"), "id", "name", []).withColumn("name", F.coalesce("name", F.lit("")))
    blocks = blocking.with_size(rows.select("er_id", F.lit("one").alias("block_key")))
    assert sorted((r.entity_a_id, r.entity_b_id) for r in matching.RuleMatcher()(rows, blocks).collect()) == [(1, 2), (3, 4)]


def test_bounded_similarity_like_the_plain_one(spark):
    r = random.Random(3)
    data = [("".join(r.choice("ab c") for _ in range(r.randint(0, 12))).strip(), "".join(r.choice("ab c") for _ in range(r.randint(0, 12))).strip()) for _ in range(400)]
    df = spark.createDataFrame(data, "a string, b string")
    for least in (0.5, 0.85, 1.0):
        rows = df.select(matching.name_similarity(F.col("a"), F.col("b")).alias("x"), matching.similarity_from("a", "b", least).alias("y")).collect()
        assert all((q.x >= least) == (q.y >= least) and (q.x < least or abs(q.x - q.y) < 1e-12) for q in rows)


def test_vector_blocks_at_the_edges(spark):
    r = random.Random(1)
    for n in (1, 10, 11, 19, 20):
        data = [(i, [r.random() for _ in range(4)]) for i in range(n)] + [(100, [0.0] * 4), (101, [0.0] * 4), (102, None)]
        got = {x.er_id: x.block_key for x in blocking.vector_blocks(spark.createDataFrame(data, "er_id long, embedding array<double>"), target=10).collect()}
        assert sorted(got) == [*range(n), 100, 101] and got[100] == got[101]
        assert n < 10 or (got[100] == "block_zero" and "block_zero" not in {got[i] for i in range(n)})


def test_centroids_in_parts(spark):
    r = random.Random(2)
    rows = spark.createDataFrame([(i, [r.random() for _ in range(4)]) for i in range(50)] + [(99, None)], "er_id long, embedding array<double>")
    centroids = spark.createDataFrame([(i, [r.random() for _ in range(4)]) for i in range(9)] + [(20, [0.5] * 4), (21, [0.5] * 4)], "centroid long, center array<double>")
    one, many = (sorted(map(tuple, blocking.assign_nearest(rows, centroids, most_mb=mb).collect()), key=str) for mb in (64, 2e-4))
    assert one == many and (99, None) in one


def test_prompts(spark):
    kind = T.StructType.fromDDL("id bigint, tags array<string>, at struct<x: double, ok: boolean>, more map<string,int>")
    assert prompts.shape(kind, {"id": "the row's number"}) == "{\n  # the row's number\n  id: int or null\n  tags: list of string or null\n  at: {\n    x: float or null\n    ok: boolean or null\n  } or null\n  more: map of string to int or null\n}"
    text = prompts.prompt("match", {"records": [{"local_id": 0}], "fields": "name", "examples": prompts.examples()})
    assert "== records ==" in text and "source_local: list of int" in text and "Nordwind" in text
    assert prompts.examples([{"own": 1}]) == json.dumps([{"own": 1}], indent=1)
    with pytest.raises(ValueError, match="examples"):
        prompts.prompt("match", {"records": [], "fields": ""})
    assert prompts.answer('Sure:\n```json\n[{"a": 1}]\n```') == [{"a": 1}]
    with pytest.raises(ValueError, match="JSON"):
        prompts.answer("no")
    for request in prompts.REQUESTS:
        assert prompts.prompt(request, dict.fromkeys(prompts.REQUESTS[request][1], "x"), many=False)


def test_blocks_through_a_client(spark):
    def ask(text):
        records = json.loads(text.split("== records ==\n")[1].split("\n\n== fields")[0])
        if any(r["name"] == "bad" for r in records):
            return "I can't"
        return "Here: " + json.dumps([{"local_id": 0, "name": records[0]["name"], "description": None, "source_local": [r["local_id"] for r in records[1:]]}])

    rows = entities.to_entities(spark.createDataFrame([(1, "a"), (2, "a2"), (3, "bad"), (4, "bad"), (5, "alone")], "id long, name string"), "id", "name", [])
    blocks = blocking.with_size(rows.select("er_id", F.floor((F.col("er_id") - 1) / 2).cast("string").alias("block_key")))
    out = {r.er_id: (r.source_ids, r.match_skip_reason) for r in matching.GroupedMatcher(prompts.block_function(ask)).resolve(rows, blocks).collect()}
    assert out == {1: ([2], None), 3: (None, "error_recovery"), 4: (None, "error_recovery"), 5: (None, "singleton_block")}


def test_embeddings_of_a_model(spark):
    rows = spark.createDataFrame([(1, "abc"), (2, None), (3, "")], "er_id long, name string")
    out = {r.er_id: r.embedding for r in prompts.model_embedding(rows, lambda ts: [[float(len(t)), 0.0] for t in ts], batch=1).collect()}
    assert out == {1: [1.0, 0.0], 2: None, 3: [0.0, 0.0]}
