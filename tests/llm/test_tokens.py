"""Token counts, segmentation, decontamination, the pipeline."""

import math
import os
import random
from collections import Counter

import numpy as np
import pytest
import pyspark.sql.functions as F

from kinfold.llm import decontaminate as dec
from kinfold.llm.common import words
from kinfold.llm.pieces import Lattice, Sampler, decoded, sample_texts, seed_of, segment
from kinfold.llm.token_counts import PrefixCounter, load, token_counts, tokens_at, truncated, unpack

from .helpers import HARD, docs, odd, prose

TOKENIZERS = os.environ.get("TOKENIZERS", "/opt/tokenizers")
RANKS, MODEL = f"{TOKENIZERS}/byte_bpe_50k.tiktoken", f"{TOKENIZERS}/piece_bpe_32k.model"


@pytest.fixture(autouse=True)
def plain_case(spark):
    yield
    spark.conf.set("spark.sql.caseSensitive", "false")


def test_prefix_counts_like_encoding_every_prefix():
    enc = load(RANKS)
    counter = PrefixCounter(enc)
    for t in ["Hello, world!  It's  fine.\n\n\n don't 12345 x", "été 🙂🙂 中文字 naïve", "   ", "a", "'ve 'll we'", "aaaaaaaaaaaaaaaaaaaaaaaa==========", prose(1, 20)]:
        assert counter.counts(t).tolist() == [len(enc.encode_ordinary(t[: i + 1])) for i in range(len(t))]


def test_token_counts_hard_rows(spark):
    enc = load(RANKS)
    out = token_counts(odd(spark, HARD), RANKS, budgets=(2, 50)).collect()
    assert len(out) == len(HARD)
    by = {(r.doc_id, r.n_tokens): r for r in out}
    assert by[(1, None)].prefix_counts is None and by[(2, 0)].fit_2 == 0
    for i, t in HARD:
        if t:
            r = by[(i, len(enc.encode_ordinary(t)))]
            assert len(unpack(r.prefix_counts)) == len(t) and tokens_at(r.prefix_counts, 3) == len(enc.encode_ordinary(t[:3]))
            assert r.fit_50 == max((k for k in range(1, min(len(t), 400) + 1) if len(enc.encode_ordinary(t[:k])) <= 50), default=0)
    d = docs(spark, [(1, prose(2, 100)), (2, "short")])
    cut = {r.doc_id: r.text for r in truncated(d, token_counts(d, RANKS), 10).collect()}
    assert cut[2] == "short" and len(enc.encode_ordinary(cut[1])) == 10
    assert token_counts(docs(spark, []), RANKS).count() == 0


def enumerate_segmentations(lattice, unit):
    """Every segmentation of a unit with its weight, by recursion over the pieces."""
    out = []

    def go(i, done, w):
        if i == len(unit):
            out.append((tuple(done), w))
            return
        single = False
        for j in range(i + 1, min(len(unit), i + lattice.longest) + 1):
            p = lattice.id.get(unit[i:j])
            if p is not None:
                single |= j == i + 1
                go(j, [*done, p], w * math.exp(lattice.log[p]))
        if not single:
            b = unit[i].encode()
            pid = lattice.byte[b[0]] if len(b) == 1 else -ord(unit[i]) - 1
            go(i + 1, [*done, pid], w * math.exp(lattice.rare * len(b)))

    go(0, [], 1.0)
    return out


@pytest.fixture(scope="module")
def lattice():
    return Lattice(MODEL)


def test_lattice_probabilities_like_enumeration(lattice):
    for text in ("hello", "naïveté", "x\ty"):
        units = lattice.units(lattice.normalized(text))
        want = [dict(enumerate_segmentations(lattice, u)) for u in units]
        totals = [sum(w.values()) for w in want]
        e = lattice.build(units)
        got = Sampler(e).sample(e.unit, np.zeros(len(units), np.int64), np.array([5], np.uint64), 6)[0]
        for pieces, logp, _ in got[:-1]:
            at, p = 0, 1.0
            for u, w, total in zip(units, want, totals, strict=True):
                best = next(k for k in range(1, len(pieces) - at + 1) if tuple(pieces[at : at + k].tolist()) in w)
                p *= w[tuple(pieces[at : at + best].tolist())] / total
                at += best
            assert at == len(pieces) and abs(math.log(p) - logp) < 1e-9
        assert len({tuple(x[0].tolist()) for x in got[:-1]}) == len(got) - 1
        keys = [x[2] for x in got]
        assert keys == sorted(keys, reverse=True)


def test_long_units_need_logarithms(lattice):
    unit = "abcdefghij" * 30
    e = lattice.build([unit])
    sums = np.add.reduceat(e.odds, e.start[:-1])
    assert np.allclose(sums, 1)


def test_first_draws_follow_the_probabilities(lattice):
    text, n = "hello", 4000
    unit = lattice.units(lattice.normalized(text))
    want = dict(enumerate_segmentations(lattice, unit[0]))
    total = sum(want.values())
    drawn = Counter()
    included = Counter()
    for got in sample_texts(lattice, [text] * n, [seed_of(i) for i in range(n)], 2):
        drawn[tuple(got[0][0].tolist())] += 1
        for pieces, logp, _ in got[:-1]:
            # Inclusion scores make the weighted sum of any statistic unbiased.
            included[tuple(pieces.tolist())] += math.exp(logp) / -math.expm1(-math.exp(min(logp - got[-1][2], 50)))
    for seg, w in sorted(want.items(), key=lambda x: -x[1])[:4]:
        p = w / total
        assert abs(drawn[seg] / n - p) < 4 * math.sqrt(p * (1 - p) / n) + 1e-3
        assert abs(included[seg] / n - p) < 0.05


def test_segment_hard_rows(spark):
    out = segment(odd(spark, HARD), MODEL).collect()
    assert len(out) == len(HARD)
    for r in out:
        if (r.doc_id, r.n_pieces) == (1, None):
            assert r.samples is None and r.exact is None
        elif r.doc_id == 2:
            assert r.samples == [] and r.n_pieces == 0
        else:
            assert r.exact and 1 <= len(r.samples) <= 2 and all(0 <= s.inclusion <= 1 for s in r.samples)
    again = {(r.doc_id, r.n_pieces): r.samples for r in segment(docs(spark, HARD).repartition(3), MODEL).collect()}
    for r in out:
        other = again[(r.doc_id, r.n_pieces)]
        assert [x.ids for x in other or []] == [x.ids for x in r.samples or []]
        assert all(abs(x.log_prob - y.log_prob) < 1e-6 and abs(x.inclusion - y.inclusion) < 1e-6 for x, y in zip(other or [], r.samples or [], strict=True))
    assert segment(docs(spark, []), MODEL).count() == 0


def test_segments_decode_to_their_texts(spark):
    rows = [*HARD, (20, "▁bar ▁▁ and  spaces "), (21, "▁"), (22, " "), (23, prose(3, 500))]
    d = docs(spark, rows)
    out = segment(d, MODEL, k=3, keep=["lang", "n_chars"])
    assert out.columns == ["doc_id", "lang", "n_chars", "n_pieces", "exact", "samples"]
    assert all(r.exact in (True, None) for r in out.collect())
    want = Counter((i, None if t is None else t) for i, t in rows)
    got = Counter()
    for r, n in zip(decoded(out, MODEL).collect(), out.select("n_chars").collect(), strict=True):
        assert r.texts is None or len(set(r.texts)) <= 1
        got[r.doc_id, None if r.texts is None else r.texts[0] if r.texts else ""] += 1
        assert r.texts is None or len(r.texts[0] if r.texts else "") == n.n_chars
    assert got == want


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_lcs_like_dynamic_programming():
    r = random.Random(0)
    for _ in range(200):
        a, b = ([r.randrange(6) for _ in range(r.randrange(1, 90))] for _ in range(2))
        assert dec.lcs(dec.bit_masks(a), len(a), b) == brute_lcs(a, b)


def test_randomised_svd_is_an_svd(spark):
    r = np.random.default_rng(0)
    m = r.random((60, 5)) @ r.random((5, 40)) + 1e-4 * r.random((60, 40))
    rows = spark.createDataFrame([(list(range(40)), x.tolist()) for x in m], "places array<int>, weights array<double>").repartition(4)
    v, s = dec.randomised_svd(rows, 40, 5)
    _, want, vt = np.linalg.svd(m, full_matrices=False)
    assert np.allclose(s, want[:5], rtol=1e-3) and np.allclose(v.T @ v, np.eye(5), atol=1e-8)
    assert np.allclose(v @ v.T, vt[:5].T @ vt[:5], atol=1e-2)


def planted(n_items=30, n_docs=160):
    r = random.Random(4)
    items = [(i, prose(1000 + i, r.randint(14, 58), 3000) + ". " + prose(2000 + i, 6, 3000) + ".") for i in range(n_items)]
    rows, want = [], set()
    for d in range(n_docs):
        a, b = prose(d, r.randint(0, 250), 3000), prose(5000 + d, r.randint(0, 250), 3000)
        if d % 4 == 0:
            i = r.randrange(n_items)
            ws = items[i][1].split()
            if d % 8 == 0:  # a paraphrase: a fifth of the words changed, some words put between
                ws = [w if r.random() > 0.2 else f"other{r.randrange(999)}" for w in ws]
                for _ in range(len(ws) // 10):
                    ws.insert(r.randrange(len(ws)), "filler")
            a = f"{a} {' '.join(ws)}"
            want.add((d, i))
        rows.append((d, f"{a} {b}"))
    return items, rows, want


def test_leaks_are_found_and_clean_rows_stay(spark):
    items, rows, want = planted()
    d, b = docs(spark, rows), spark.createDataFrame(items, "item_id bigint, text string")
    model = dec.Decontaminator(d, b)
    got = {(r.doc_id, r.item_id) for r in dec.leaks(d, model).collect()}
    brute = set()
    for i, t in rows:
        ws = words(t)
        for k, x in items:
            q = words(x)
            if any(brute_lcs(q, ws[s : s + len(q) + 8]) >= 0.7 * len(q) for s in range(0, max(1, len(ws) - len(q) // 2), 4)):
                brute.add((i, k))
    assert len(got & want) >= 0.95 * len(want) and len(brute - got) <= 0.1 * len(brute)
    assert {i for i, _ in got} <= {i for i, _ in want}
    assert {r.doc_id for r in dec.drop_leaks(d, model).collect()} == {i for i, _ in rows} - {i for i, _ in got}
    low = dec.Decontaminator(d, b, rank=12)
    assert next(low.indexes()).values.shape[0] == 12
    assert len({(r.doc_id, r.item_id) for r in dec.leaks(d, low).collect()} & want) > 0


@pytest.mark.parametrize(("n_items", "size"), [(2000, 38), (60, 250)])
def test_many_and_long_items_are_all_found(spark, n_items, size):
    r = random.Random(size)
    vocab = [f"v{k}" for k in range(20_000)]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(i, text(size)) for i in range(n_items)]
    d = docs(spark, [(i, f"{text(30)} {t} {text(30)}") for i, t in items])
    b = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(x.doc_id, x.item_id) for x in dec.leaks(d, dec.Decontaminator(d, b)).collect()}
    assert got == {(i, i) for i, _ in items}


def test_items_of_any_length_and_text_ids(spark):
    """Copies are found without exception, paraphrases as brute force finds them."""
    r = random.Random(12)
    items, rows, copies = [], [], set()
    for k, size in enumerate([4, 12, 30, 80, 120, 300] * 2):
        items.append((f"i{k}", f"{prose(4000 + k, size, 3000)}. {prose(6000 + k, 5, 3000)}."))
        ws = items[-1][1].split()
        rows.append((f"c{k}", f"{prose(k, 200, 3000)} {' '.join(ws)} {prose(900 + k, 90, 3000)}"))
        copies.add((f"c{k}", f"i{k}"))
        ws = [w if r.random() > 0.2 else f"other{r.randrange(999)}" for w in ws]
        rows.append((f"p{k}", f"{prose(200 + k, 150, 3000)} {' '.join(ws)} {prose(700 + k, 90, 3000)}"))
    rows += [(f"n{k}", prose(8000 + k, 300, 3000)) for k in range(20)]
    d, b = spark.createDataFrame(rows, "doc_id string, text string"), spark.createDataFrame(items, "item_id string, text string")
    got = {(x.doc_id, x.item_id) for x in dec.leaks(d, dec.Decontaminator(d, b)).collect()}
    assert copies <= got
    brute = set()
    for i, t in rows:
        ws = words(t)
        for k, x in items:
            q = set(words(x))
            if len(q & set(ws)) < 0.7 * len(q):
                continue
            q = words(x)
            masks = dec.bit_masks(q)
            if any(dec.lcs(masks, len(q), ws[s : s + len(q)]) >= 0.7 * len(q) for s in range(max(1, len(ws) - len(q) + 1))):
                brute.add((i, k))
    assert brute <= got and {x for x in got if x[0][0] == "n"} == set()


def reworded(n_items=24, n_docs=600):
    """Texts on 12 topics, whose concepts have two words each of the same company; items, and texts that
    say them with each concept's other word and their last sentence as it is."""
    r = random.Random(21)
    fill, pair = [f"f{k}" for k in range(40)], lambda t, c: (f"t{t}c{c}a", f"t{t}c{c}b")
    text = lambda t, n: [r.choice(fill) if r.random() < 0.5 else r.choice(pair(t, r.randrange(25))) for _ in range(n)]
    items, rows, want = [], [(d, " ".join(text(d % 12, 120))) for d in range(n_docs)], set()
    for i in range(n_items):
        cs = r.sample(range(25), 20)
        said = [[w for c in cs[:17] for w in (fill[(7 * c + i) % 40], pair(i % 12, c)[x])] for x in (0, 1)]
        last = " ".join(pair(i % 12, c)[0] for c in cs[17:])
        items.append((i, f"{' '.join(said[0])}. {last}."))
        rows.append((10_000 + i, f"{' '.join(text((i + 5) % 12, 60))} {' '.join(said[1])}. {last}. {' '.join(text((i + 5) % 12, 60))}"))
        want.add((10_000 + i, i))
    return items, rows, want


def test_the_latent_space_finds_items_in_other_words(spark):
    items, rows, want = reworded()
    d, b = docs(spark, rows), spark.createDataFrame(items, "item_id bigint, text string")
    model = dec.Decontaminator(d, b, rank=12)
    found = {(x.doc_id, x.item_id): x for x in dec.leaks(d, model).collect()}
    only_words = dec.Decontaminator(d, b, rank=12, near=2.0)
    by_words = {(x.doc_id, x.item_id) for x in dec.leaks(d, only_words).collect()}
    assert not by_words & want and by_words <= set(found)
    assert len(want & set(found)) >= 0.9 * len(want) and {i for i, _ in found} <= {i for i, _ in want}
    assert all(found[k].cosine >= model.near and found[k].kind == "paraphrase" for k in want & set(found))
    assert {x.doc_id for x in dec.drop_leaks(d, model).collect()} == {i for i, _ in rows} - {i for i, _ in found}


def test_latent_windows_against_every_window(spark):
    """At least 0.9 of the leaks that a search of each window of an item's own length finds."""
    items, rows, _ = reworded()
    d, b = docs(spark, rows), spark.createDataFrame(items, "item_id bigint, text string")
    model = dec.Decontaminator(d, b, rank=12)
    index = next(model.indexes())
    (x,), space, known = index.items, model.space, model.space.terms()
    brute = set()
    for d_id, t in rows[-60:]:
        h, n = dec.word_hashes([t])
        vectors = space.vectors[space.places(known, h)].astype(float)
        region = dec.Terms(x.size, x.terms).places(h)
        for i, seq in enumerate(x.seqs):
            for s in range(max(1, len(h) - len(seq) + 1)):
                v = vectors[s : s + len(seq)].sum(axis=0)
                if v @ x.latent[i] < model.near * np.linalg.norm(v):
                    continue
                got = dec._leaks(x, iter([(0, i, 0.0, s, min(len(h), s + len(seq)), region, 0, len(h))]), [dec.bit_masks(q) for q in x.seqs], [dec.bit_masks(q) for q in x.answers], model.copy, model.like, model.answered)
                if got:
                    brute.add((d_id, i))
                    break
    state = {}
    found = {(d_id, i) for d_id, t in rows[-60:] for _, i in index.found([t], state)}
    assert len(brute) > 15 and len(brute & found) >= 0.9 * len(brute)


def test_searches_look_only_where_a_leak_can_be(spark, monkeypatch):
    """Every region with enough of an item's words in order lies within a stretch that is searched, and
    no more than a tenth of the words of texts without leaks are looked up in the latent space."""
    items, rows, want = planted(20, 40)
    d, b = docs(spark, rows), spark.createDataFrame(items, "item_id bigint, text string")
    model = dec.Decontaminator(d, b)
    (x,) = next(model.indexes()).items
    at, n = dec.Terms(x.size, x.terms).tokens([t for _, t in rows])
    inside = {}
    for s in x.stretches(at, n):
        for i, r, low, high, first in zip(s.item.tolist(), s.row.tolist(), s.start.tolist(), s.end.tolist(), s.first.tolist(), strict=True):
            inside.setdefault((i, r), []).append((low - first, high - first))
    regions, one = 0, lambda v: np.array([v])
    for r, part in enumerate(np.split(at, np.cumsum(n)[:-1])):
        for i, seq in enumerate(x.seqs):
            for s in range(0, max(1, len(part) - len(seq) + 1), 3):
                low, high = (int(v[0]) for v in x.region(one(i), one(s), one(min(len(part), s + len(seq))), one(0), one(len(part))))
                if dec.lcs(dec.bit_masks(seq), len(seq), part[low:high].tolist()) >= model.like * len(seq):
                    regions += 1
                    assert any(a <= low and high <= e for a, e in inside.get((i, r), ()))
    assert regions > len(want)

    r = random.Random(3)
    vocab = [f"v{k}" for k in range(2_000)]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    clean, items = [text(200) for _ in range(80)], [(i, text(38)) for i in range(100)]
    d, b = docs(spark, list(enumerate(clean))), spark.createDataFrame(items, "item_id bigint, text string")
    index = next(dec.Decontaminator(d, b).indexes())
    looked, places = [], dec.Space.places
    monkeypatch.setattr(dec.Space, "places", lambda self, known, h: looked.append(len(h)) or places(self, known, h))
    assert index.found(clean, {}) == {} and sum(looked) <= 0.1 * 80 * 200
    assert {k for k, _ in index.found([f"{text(50)} {t}" for _, t in items], {})} == set(range(100)) and sum(looked) >= 100 * 17


def test_a_large_benchmark_is_cut_in_parts(spark):
    items, rows, want = planted(40, 80)
    d, b = docs(spark, rows), spark.createDataFrame(items, "item_id bigint, text string")
    one, many = dec.Decontaminator(d, b), dec.Decontaminator(d, b, most_mb=0)
    many.parts = 3
    key = lambda m: sorted((r.doc_id, r.item_id, r.kind) for r in dec.leaks(d, m).collect())
    assert one.parts == 1 and key(one) == key(many)
    assert sorted(r.doc_id for r in dec.drop_leaks(d, one).collect()) == sorted(r.doc_id for r in dec.drop_leaks(d, many).collect())
    assert dec.Decontaminator(d, b, rank=4, most_mb=0).parts > 1


def test_decontamination_hard_rows(spark):
    d = odd(spark, [*HARD, (20, "alpha beta gamma delta epsilon zeta eta theta")])
    b = spark.createDataFrame([(1, None), (2, ""), (None, "x y z"), (3, "alpha beta gamma delta epsilon zeta eta theta"), (4, "!!")], "item_id bigint, text string")
    model = dec.Decontaminator(d, b)
    assert [(r.doc_id, r.item_id) for r in dec.leaks(d, model).collect()] == [(20, 3)]
    assert dec.drop_leaks(d, model).count() == len(HARD)
    none = dec.Decontaminator(d, b.limit(0))
    assert dec.leaks(d, none).count() == 0 and dec.drop_leaks(d, none).count() == len(HARD) + 1
    empty = docs(spark, [])
    assert dec.leaks(empty, dec.Decontaminator(empty, b)).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    items, rows, want = planted(10, 60)
    hot = "truly vile words here"
    extra = [(1000 + k, prose(9000 + k, 60, 3000) + (f" vile {hot}" if k % 3 == 0 else "")) for k in range(90)]
    near = prose(77, 150, 3000).split()
    copies = [(2000 + k, " ".join([*near[:70], f"z{k}", *near[71:]])) for k in range(3)]
    shared = prose(88, 55, 3000)
    lines = [(3000 + k, f"{prose(300 + k, 30, 3000)}\n{shared}") for k in range(2)]
    table = [*rows, *extra, *copies, *lines, (5000, None), (5001, "")]
    docs(spark, table).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int("vile" in t)) for i, t in extra], "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "near dedup", "decontamination", "segmentation"]
    out = corpus_pipeline.run(spark, str(tmp_path))
    ids = {r.doc_id for r in out.collect()}
    bad = {i for i, t in extra if "vile" in t} | {2001, 2002} | {d for d, _ in want}
    assert not ids & {i for i, t in extra if "vile" in t} and not ids & {2001, 2002}
    assert len(ids & {d for d, _ in want}) <= 0.05 * len(want)
    assert ids >= {i for i, _ in table} - bad
    step = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, f) in enumerate(corpus_pipeline.STAGES[:-1]):
        step = f(spark, step, str(tmp_path))
        assert step.columns == ["doc_id", "text", "lang", "source", "n_chars"], k
    assert shared not in step.where(F.col("doc_id") == 3001).first().text


def test_pipeline_hard_rows(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows, ties; then empty tables."""
    import corpus_pipeline

    labels, benchmark = "doc_id bigint, toxic int", "item_id bigint, text string"
    docs(spark, HARD).write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.createDataFrame([(4, 0), (None, 1), (9, None)], labels).write.parquet(f"{tmp_path}/a/labels.parquet")
    spark.createDataFrame([(1, None), (None, "x"), (2, "")], benchmark).write.parquet(f"{tmp_path}/a/benchmark.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/a")
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "n_pieces", "exact", "samples"]
    rows = out.collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == [(False, i) for i in (1, 2, 3, 4, 6, 7, 8, 9)] + [(True, 0)]
    assert all(r.exact or r.samples is None for r in rows)
    docs(spark, []).write.parquet(f"{tmp_path}/b/documents.parquet")
    spark.createDataFrame([], labels).write.parquet(f"{tmp_path}/b/labels.parquet")
    spark.createDataFrame([], benchmark).write.parquet(f"{tmp_path}/b/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0
