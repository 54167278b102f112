"""Exact, line and near dedup against brute force."""

import numpy as np
import pytest

from kinfold.llm.common import words
from kinfold.llm.exact_dedup import exact_dedup
from kinfold.llm.line_dedup import CuckooFilter, LineIndex, dedup_lines
from kinfold.llm.near_dedup import BUCKETS, chance, jaccard, load, near_dedup, near_groups, registers, shingles

from .helpers import HARD, SCHEMA, docs, odd, prose


@pytest.fixture(autouse=True)
def plain_case(spark):
    yield
    spark.conf.set("spark.sql.caseSensitive", "false")


def test_exact_keeps_the_lowest_id_and_counts(spark):
    got = {(r.doc_id, r.text): r.copies for r in exact_dedup(docs(spark, HARD)).collect()}
    assert got[(4, "same text")] == 3
    assert got[(1, None)] == 1 and got[(2, "")] == 1 and got[(None, "no id here")] == 1
    assert len(got) == len({t for _, t in HARD})


def test_exact_is_the_same_however_it_is_partitioned(spark):
    rows = [(i, f"t{i % 37}") for i in range(500)]
    one, two = (sorted(map(tuple, exact_dedup(docs(spark, rows).repartition(k)).collect())) for k in (1, 7))
    assert one == two and len(one) == 37 and sum(r[-1] for r in one) == 500


def test_exact_odd_columns_and_empty(spark):
    out = exact_dedup(odd(spark, HARD))
    assert out.columns[-1] == "copies_1" and out.count() == len({t for _, t in HARD})
    assert exact_dedup(docs(spark, [])).count() == 0


def brute_lines(rows):
    seen, out = set(), {}
    whole = set()
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] if r[0] is not None else type(rows[0][0])())):
        if t is None or not t.strip(" \t\r\x0b\x0c\n"):
            out.setdefault((i, t), []).append(t)
            continue
        kept = []
        for line in t.split("\n"):
            bare = line.strip(" \t\r\x0b\x0c")
            if bare and bare in seen:
                continue
            seen.add(bare)
            kept.append(line)
        new = "\n".join(kept)
        if new.strip(" \t\r\x0b\x0c\n") and (i, t) not in whole:
            out.setdefault((i, t), []).append(new)
        whole.add((i, t))
    return sorted(((i, x) for (i, _), xs in out.items() for x in xs), key=str)


def test_lines_like_brute_force(spark):
    rows = [(i, "\n".join(prose(i * 7 % 11 + j, 2, 6) for j in range(5))) for i in range(60)] + HARD
    got = sorted(((r.doc_id, r.text) for r in dedup_lines(docs(spark, rows), n_chars="n_chars").collect()), key=str)
    assert got == brute_lines(rows)


def test_lines_odd_columns_and_empty(spark):
    assert dedup_lines(odd(spark, HARD), n_chars="n_chars").count() == len(brute_lines(HARD))
    assert dedup_lines(docs(spark, [])).count() == 0


def test_line_index_takes_documents_back(spark):
    a, b = docs(spark, [(1, "one\ntwo"), (2, "two\nthree")]), docs(spark, [(3, "three\nfour\nfour"), (4, None)])
    index, _ = LineIndex(spark, 4).insert(a)
    before = sorted(map(tuple, index.counts().collect()))
    more, repeats = index.insert(b)
    assert repeats.count() == 2
    assert sorted(map(tuple, more.delete(b).counts().collect())) == before
    assert more.delete(b).probe(docs(spark, [(9, "four")])).count() == 0
    assert index.probe(docs(spark, [(9, "one")])).count() == 1
    assert sum(r.refs for r in more.counts().collect()) == 7


def test_line_index_gives_back_only_what_it_holds(spark, tmp_path):
    a = docs(spark, [(1, "one\ntwo"), (2, "two\nthree"), (2, "two\nthree"), (5, None), (None, "x")])
    index, _ = LineIndex(spark, 4).insert(a)
    count = lambda i: sorted(r.refs for r in i.counts().collect())
    assert count(index) == [1, 1, 2, 3]
    for odd_ones in ([(99, "one\ntwo")], [(1, "one")], [(5, None)], []):  # not held: nothing changes
        assert count(index.delete(docs(spark, odd_ones))) == [1, 1, 2, 3]
    once = index.delete(docs(spark, [(2, "two\nthree"), (2, "two\nthree"), (2, "two\nthree"), (None, "x")]))
    assert count(once) == [1, 1] and count(once.delete(docs(spark, [(2, "two\nthree")]))) == [1, 1]
    index.save(f"{tmp_path}/index")
    again = LineIndex.load(spark, f"{tmp_path}/index")
    assert again.shards == index.shards and count(again.delete(a)) == [] and again.probe(docs(spark, [(7, "three")])).count() == 1
    assert count(again.resharded(9)) == [1, 1, 2, 3] and again.resharded(9).probe(docs(spark, [(7, "three"), (8, "no")])).count() == 1
    with pytest.raises(ValueError):
        index.insert(a, keep=False)[0].delete(a)


def test_line_index_grows(spark):
    index = LineIndex(spark, 2, per_shard=50)
    for k in range(2):
        index, _ = index.insert(docs(spark, [(k * 100 + i, "\n".join(f"l{k} {i} {j}" for j in range(60))) for i in range(80)]))
    assert index.shards >= 128 and index.counts().count() == 2 * 80 * 60
    assert index.probe(docs(spark, [(0, "l0 3 4\nl1 7 59\nnew")])).count() == 2


@pytest.mark.parametrize("batches", [1, 3])
def test_lines_in_batches_and_with_text_ids(spark, batches):
    rows = [(i, "\n".join(prose(i * 7 % 11 + j, 2, 6) for j in range(5))) for i in range(60)] + HARD
    got = sorted(((r.doc_id, r.text) for r in dedup_lines(docs(spark, rows).repartition(3), batches=batches).collect()), key=str)
    assert got == brute_lines(rows)
    named = [(None if i is None else f"d{i:03}", t) for i, t in rows]
    out = dedup_lines(spark.createDataFrame(named, "doc_id string, text string"), batches=batches).collect()
    assert sorted(((r.doc_id, r.text) for r in out), key=str) == brute_lines(named)


def test_lines_after_an_index(spark):
    index, _ = LineIndex(spark, 4).insert(docs(spark, [(1, "old\nolder")]))
    out = {r.doc_id: r.text for r in dedup_lines(docs(spark, [(2, "new\nold"), (3, "older"), (4, "new\nx")]), index=index).collect()}
    assert out == {2: "new", 4: "x"}


def test_cuckoo_filter_never_misses_and_forgets():
    keys = np.random.default_rng(0).integers(-(2**62), 2**62, 5000)
    f = CuckooFilter.of(keys)
    assert f.contains(keys).all()
    f.remove(keys[:2500])
    assert f.contains(keys[2500:]).all() and f.contains(keys[:2500]).mean() < 0.01


def near_brute(rows, threshold=0.55, size=3):
    sets = {}
    for i, t in rows:
        if t is not None and words(t):
            sets[i] = set(np.unique(shingles([t], size)[0]).tolist())
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[:n]:
            if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    groups = {}
    for i in ids:
        groups.setdefault(find(i), []).append(i)
    return {i: g for g, m in groups.items() if len(m) > 1 for i in m}


def test_near_groups_like_brute_force(spark):
    rows = []
    for g in range(25):
        base = prose(g, 120, 4000).split()
        for c in range(1 + g % 4):
            copy = list(base)
            for k in range(c * 3):
                copy[(k * 37 + c) % 120] = f"new{g}x{c}x{k}"
            rows.append((len(rows), " ".join(copy)))
    got = {r.doc_id: r.group_id for r in near_groups(docs(spark, rows)).collect()}
    want = near_brute(rows)
    hit = sum(got.get(i) == g for i, g in want.items())
    assert hit >= 0.9 * len(want) and set(got) <= set(want)
    kept = {r.doc_id for r in near_dedup(docs(spark, rows)).collect()}
    assert kept == {i for i, _ in rows if got.get(i, i) == i}


def test_near_pairs_in_a_family_are_not_swallowed(spark):
    # All share a passage (J about 0.45); each two of a pair share more (J about 0.58).
    rows = []
    for g in range(150):
        common = " ".join(f"s{k}" for k in range(124))
        pair = " ".join(f"g{g}x{k}" for k in range(24))
        rows += [(2 * g + c, f"{common} {pair} " + " ".join(f"g{g}c{c}x{k}" for k in range(52))) for c in range(2)]
    want = near_brute(rows)
    got = {r.doc_id: r.group_id for r in near_groups(docs(spark, rows)).collect()}
    assert len(want) == len(rows) and set(got) <= set(want)
    assert sum(got.get(i) == g for i, g in want.items()) >= 0.95 * len(want)


def test_near_short_texts_with_equal_registers_are_no_copies(spark):
    texts = [f"a{i} b{i} c{i}" for i in range(6000)]
    regs = [r.tobytes() for r in registers(*shingles(texts, 3), len(texts))]
    texts = [t for t, r in zip(texts, regs, strict=True) if regs.count(r) > 1][:12]
    assert len(texts) > 3
    rows = [*enumerate(texts), (9000, texts[0])]
    assert {r.doc_id: r.group_id for r in near_groups(docs(spark, rows)).collect()} == {0: 0, 9000: 0}


def test_near_hard_rows(spark):
    out = near_dedup(odd(spark, HARD))
    ids = [r.doc_id for r in out.collect()]
    assert ids.count(4) == 1 and 5 not in ids and {1, 2, 3, 6, 7, 8, 9, None} <= set(ids)
    assert near_dedup(docs(spark, [])).count() == 0
    assert near_groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_registers_estimate_jaccard():
    r = np.random.default_rng(1)
    common, a, b = (r.integers(0, 2**63, n).astype(np.uint64) for n in (3000, 1000, 1000))
    both = [np.concatenate([common, x]) for x in (a, b)]
    reg = registers(np.concatenate(both), np.repeat([0, 1], 4000), 2)
    assert reg.shape == (2, BUCKETS) and abs(float(jaccard(reg[0], reg[1])) - 0.6) < 0.15


def test_registers_give_sizes_and_chance_agreements():
    r = np.random.default_rng(2)
    for n, m in ((40, 40), (2_000, 2_000), (3_000, 90_000)):
        rows = 300
        reg = [registers(r.integers(0, 2**63, rows * k).astype(np.uint64) * np.uint64(2) + np.uint64(1), np.repeat(np.arange(rows), k), rows) for k in (n, m)]
        for x, k in zip(reg, (n, m), strict=True):
            assert abs(load(x).mean() * BUCKETS / k - 1) < 0.1
        used = (reg[0] != 0xFFFF) | (reg[1] != 0xFFFF)
        agree = ((reg[0] == reg[1]) & used).sum() / used.sum()
        assert abs(agree - chance(load(reg[0]), load(reg[1])).mean()) < 3e-4
        assert jaccard(reg[0], reg[1]).mean() < 2e-3


def test_near_groups_with_text_ids(spark):
    base = prose(5, 100, 4000)
    rows = [("b", base), ("a", base + " more"), ("c", prose(6, 100, 4000)), (None, base)]
    out = {r.doc_id: (r.group_id, r.keep) for r in near_groups(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert out == {"a": ("a", True), "b": ("a", False), None: ("a", False)}
    assert sorted(r.doc_id for r in near_dedup(spark.createDataFrame(rows, "doc_id string, text string")).collect()) == ["a", "c"]
