"""Toxicity, language model, licences, URLs."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from kinfold.llm import toxicity as tox
from kinfold.llm import url_filter
from kinfold.llm.common import Terms, bucket_frequencies, pieces, summed, word_hashes, words
from kinfold.llm.hmm import HiddenMarkov, encoded, lm_scores, scored, train, vocabulary, word_counts
from kinfold.llm.licenses import TEMPLATES, ancestors, license_scan, license_texts

from .helpers import HARD, docs, odd, prose


@pytest.fixture(autouse=True)
def plain_case(spark):
    yield
    spark.conf.set("spark.sql.caseSensitive", "false")


def test_word_hashes_find_the_same_words():
    texts = ["", "a", "Été “quoted”—dash … ΑΒΓ 中文 x_y 12", "\n\n ß", " lead", "trail ", "a-b\tc", "averyverylongwordindeedwithmanyletters averyverylongwordindeedwithmanylettert"]
    h, n = word_hashes(texts)
    found = [words(t) for t in texts]
    assert n.tolist() == [len(f) for f in found]
    seen = {}
    for w, x in zip([w for f in found for w in f], h.tolist(), strict=True):
        assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)
    t = Terms(1 << 10, ["a", "x_y", "zzz"])
    assert [p - 1024 for p in t.tokens(["a x_y q"])[0].tolist() if p >= 1024] == [0, 1]


def test_bucket_frequencies_count_texts(spark):
    rows = [(i, prose(i, 30, 60)) for i in range(40)] + HARD
    df, n = bucket_frequencies(docs(spark, rows).repartition(5), "text")
    texts = [t for _, t in rows if t is not None]
    want = np.zeros_like(df)
    for t in texts:
        want[np.unique(Terms(len(df)).tokens([t])[0])] += 1
    assert n == len(texts) and (df == want).all()


def test_sums_are_exact(spark):
    one = np.arange(3000, dtype=float).reshape(1500, 2)
    got = summed(spark.range(7).repartition(7).mapInArrow(lambda bs: (pieces(one * b.num_rows) for b in bs if b.num_rows), "at int, cells binary"), one.shape)
    assert (got == one * 7).all()


BAD = ["vile", "grotty", "loathsome"]


def toxic_rows(n, seed):
    r, rows = random.Random(seed), []
    for i in range(n):
        ws, y = prose(seed * 10_000 + i, 40, 300).split(), int(r.random() < 0.3)
        if y:
            for w in r.sample(BAD, r.randint(1, 2)):
                ws.insert(r.randrange(len(ws)), w)
        rows.append((i, " ".join(ws), y))
    return rows


def test_toxicity_on_held_out_rows(spark):
    rows = toxic_rows(500, 1)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows[:300]] + [(None, 1), (7, None), (10**6, 1)], "doc_id bigint, toxic int")
    d = docs(spark, [(i, t) for i, t, _ in rows])
    model = tox.train(d, labels)
    out = {r.doc_id: r for r in tox.toxicity(d, model).collect()}
    right = [out[i].toxic == bool(y) for i, _, y in rows[300:]]
    assert sum(right) >= 0.97 * len(right)
    hit = next(out[i] for i, _, y in rows if y)
    assert hit.neighbours and hit.terms and all(0 <= x.cosine <= 1 + 1e-9 for x in hit.neighbours)
    assert {r.doc_id for r in tox.drop_toxic(d, model).collect()} == {i for i, r in out.items() if not r.toxic}
    hard = {(r.doc_id, r.score is None, r.toxic) for r in tox.toxicity(odd(spark, HARD), model).collect()}
    assert (1, True, False) in hard and not any(t for _, _, t in hard)
    assert tox.drop_toxic(odd(spark, HARD), model).count() == len(HARD)
    assert tox.toxicity(docs(spark, []), model).count() == 0


def test_toxicity_without_labels(spark):
    d = docs(spark, HARD)
    model = tox.train(d, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert tox.drop_toxic(d, model).count() == len(HARD)
    one = tox.train(d, spark.createDataFrame([(4, 0), (8, 0)], "doc_id bigint, toxic int"))
    assert not any(r.toxic for r in tox.toxicity(d, one).collect())


def sparse(v):
    return tox.Sparse.of([[(int(t), float(x)) for t, x in enumerate(row) if x] for row in v])


def test_block_max_search_is_exact():
    r = np.random.default_rng(3)
    v = r.random((700, 9)) * (r.random((700, 9)) < 0.4)
    index = tox.BlockMaxIndex(sparse(v), 9, np.arange(700), (r.random(700) < 0.5).astype(float), block=16)
    unit = v[np.linalg.norm(v, axis=1) > 0]
    unit = np.round(unit / np.linalg.norm(unit, axis=1)[:, None], 9)
    for k in (1, 5, 40):
        q = r.random(9) * (r.random(9) < 0.5)
        q[0] += 0.1
        q /= np.linalg.norm(q)
        terms = np.flatnonzero(q)
        _, cos = index.search(terms.tolist(), q[terms], k)
        want = np.sort(unit @ q)[::-1]
        assert abs(cos[0] - want[0]) < 1e-8 and abs(cos[-1] - want[k - 1]) < 1e-8
    empty = tox.BlockMaxIndex(sparse(np.zeros((2, 3))), 3, np.arange(2), np.zeros(2))
    assert len(empty.search([0], np.ones(1), 3)[0]) == 0


def brute_toxicity(examples, labels, texts, terms, weights, k, common, share):
    """Scores by cosine to every example, ties included, votes, leave-one-out calibration."""
    def vector(t):
        c = Counter(x for w in words(t) for x in tox.terms_of(w) if x in terms)
        return {x: n * weights[x] for x, n in c.items()}

    body = [vector(t) for t in examples]
    norms = [math.sqrt(sum(v * v for v in x.values())) for x in body]
    extra = common * float(np.median([n for n in norms if n]))
    full = [{**x, "": extra} for x in body]
    each = [share[int(y)] for y in labels]
    base = sum(e * y for e, y in zip(each, labels, strict=True)) / sum(each)

    def cosine(a, b):
        return round(sum(v * b.get(x, 0) for x, v in a.items()) / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values())), 9)

    def vote(q, without=None):
        cos = [cosine(q, x) for x in full]
        least = sorted(cos, reverse=True)[min(k, len(cos)) - 1]
        got = [(c, y) for c, y in zip(cos, labels, strict=True) if c >= least - 2e-9]
        yes, no = sum(c * c * y for c, y in got), sum(c * c * (1 - y) for c, y in got)
        if without is not None:
            yes, no = yes - without, no - (1 - without)
        return (yes * share[1] + base) / (yes * share[1] + no * share[0] + 1)

    raw = [vote(q, y) for q, y in zip(full, labels, strict=True)]
    # The greatest monotone fit: at x, the greatest mean from a to x's end over the least to any later one.
    xs = sorted(set(raw))

    def mean(i, j):
        own = [(y, e) for r, y, e in zip(raw, labels, each, strict=True) if xs[i] <= r <= xs[j]]
        return sum(y * e for y, e in own) / sum(e for _, e in own)

    fit = [max(min(mean(i, j) for j in range(at, len(xs))) for i in range(at + 1)) for at in range(len(xs))]
    out = []
    for t in texts:
        v = vote({**vector(t), "": extra})
        below = [f for x, f in zip(xs, fit, strict=True) if x <= v + 1e-12]
        out.append(below[-1] if below else fit[0])
    return out


def test_toxicity_like_brute_force(spark):
    rows = toxic_rows(90, 3)
    rows += [(200 + i, t, y) for i, (_, t, y) in enumerate(rows[:10])]  # repeated texts
    rows += [(300 + i, rows[1][1], i % 2) for i in range(6)]  # equal texts with either label: ties vote
    rows += [(400, "vile " * 3000, 1), (401, "plain words only", 0), (402, "vile", 0)]
    labels = spark.createDataFrame([(f"d{i}", y) for i, _, y in rows], "doc_id string, toxic int")
    d = spark.createDataFrame([(f"d{i}", t, "s", 1) for i, t, _ in rows] + [("new", "a vile and grotty thing", "s", 1), (None, "nothing", "s", 1)], "doc_id string, text string, y string, g int")
    model = tox.train(d, labels, k=7, doubt=5.0)
    assert len(model.index.ids) == len(rows) and {"vile", "grotty"} & set(model.lexicon)
    texts = [t for _, t, _ in rows] + ["a vile and grotty thing", "nothing"]
    df = Counter(x for t in texts for x in {x for w in words(t) for x in tox.terms_of(w)})
    weights = {x: math.log((1 + len(texts)) / (1 + df[x])) + 1 for x in model.lexicon}
    want = brute_toxicity([t for _, t, _ in rows], [y for *_, y in rows], texts, set(model.lexicon), weights, 7, 0.75, model.share)
    got = {r.doc_id: r for r in tox.toxicity(d, model).collect()}
    for i, w in zip([f"d{i}" for i, *_ in rows] + ["new", None], want, strict=True):
        assert abs(got[i].score - w) < 1e-6, (i, got[i].score, w)
    assert all(x.doc_id.startswith("d") for x in got["new"].neighbours)


def test_toxicity_keeps_unlike_rows_with_one_hash_in_common(spark):
    rows = [(i, f"one two three {prose(i, 30, 200)} {'vile' if i % 2 else 'calm'}", i % 2) for i in range(60)]
    model = tox.train(docs(spark, [(i, t) for i, t, _ in rows]), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int"))
    assert sorted(model.index.ids.tolist()) == list(range(60))
    few = tox.train(docs(spark, [(i, t) for i, t, _ in rows]), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int"), most_terms=2, doubt=5.0)
    assert len(few.lexicon) <= 2


def brute_likelihood(model, seq):
    total = 0.0
    states = range(len(model.start))
    paths = [([s], model.start[s] * model.emit[seq[0], s]) for s in states]
    for x in seq[1:]:
        paths = [(p + [s], w * model.move[p[-1], s] * model.emit[x, s]) for p, w in paths for s in states]
    total = sum(w for _, w in paths)
    return math.log(total), paths


def test_forward_and_counts_like_enumeration():
    r = np.random.default_rng(5)
    norm = lambda x, a: x / x.sum(axis=a, keepdims=True)
    m = HiddenMarkov(norm(r.random(3), 0), norm(r.random((3, 3)), 1), norm(r.random((6, 3)), 0))
    seqs = [r.integers(0, 6, n) for n in (1, 4, 6, 3, 6)]
    flat, n = np.concatenate(seqs), np.array([len(s) for s in seqs])
    want = [brute_likelihood(m, s) for s in seqs]
    assert np.allclose(m.log_likelihood(flat, n), [w for w, _ in want])
    start, moves, emitted = np.zeros(3), np.zeros((3, 3)), np.zeros((6, 3))
    for s, (log, paths) in zip(seqs, want, strict=True):
        for p, w in paths:
            w /= math.exp(log)
            start[p[0]] += w
            for a, b in zip(p, p[1:], strict=False):
                moves[a, b] += w
            for x, st in zip(s, p, strict=True):
                emitted[x, st] += w
    got = m.counted(flat, n)
    assert np.allclose(got[0], start, atol=1e-4) and np.allclose(got[1], moves, atol=1e-4) and np.allclose(got[2], emitted, atol=1e-4)
    assert abs(got[3] - sum(w for w, _ in want)) < 1e-3


def test_training_raises_likelihood_and_words_sum_to_one(spark):
    d = docs(spark, [(i, prose(i, 60, 80)) for i in range(60)])
    vocab, counts = vocabulary(d, terms=50, shared=16)
    assert counts.sum() == 60 * 60 and len(vocab.hashes) == 50
    corpus = encoded(d, vocab)
    model, logs = train(corpus, counts, states=4, rounds=4)
    assert all(b >= a - 1e-3 * abs(a) for a, b in zip(logs[1:], logs[2:], strict=False))
    assert np.allclose(model.emit.sum(axis=0), 1) and np.allclose(model.move.sum(axis=1), 1)


def test_scores_like_a_forward_pass_word_by_word(spark):
    """Encoding, shared symbols' shares and the join, against one text and one word at a time."""
    rows = [(i, prose(i, 5 + 40 * (i % 3), 300)) for i in range(50)] + [(60, "x"), (61, prose(3, 3000, 300)), (62, prose(3, 3000, 300))]
    d = docs(spark, rows).repartition(3)
    vocab, counts = vocabulary(d, terms=40, shared=8)
    model, _ = train(encoded(d, vocab).cache(), counts, states=3, rounds=2)
    got = {r.doc_id: r for r in scored(encoded(d, vocab).cache(), model, vocab).collect()}
    n = Counter(w for _, t in rows for w in words(t))
    h = {w: int(word_hashes([w])[0][0]) for w in n}
    top = sorted(n, key=lambda w: (-n[w], np.uint64(h[w]).astype(np.int64)))[:40]
    assert {h[w] for w in top} == set(vocab.hashes.tolist())
    total = Counter()
    for w in n:
        if w not in top:
            total[h[w] & 7] += n[w]
    place = {x: 8 + k for k, x in enumerate(vocab.hashes.tolist())}
    for i, t in rows:
        log, a = 0.0, None
        for w in words(t):
            own = 1.0 if w in top else n[w] / (total[h[w] & 7] + 1)
            e = model.emit[place[h[w]] if w in top else h[w] & 7] * own
            a = (model.start if a is None else a @ model.move) * e
            log += math.log(a.sum())
            a = a / a.sum()
        assert got[i].n_words == len(words(t)) and abs(got[i].log_likelihood - log) < 1e-4 and abs(got[i].score - log / len(words(t))) < 1e-6
    assert got[61].score == got[62].score


def test_word_counts_when_tasks_send_early(spark):
    rows = [(i, prose(i, 200, 250)) for i in range(80)] + HARD
    got = {r.h: r.n for r in word_counts(docs(spark, rows).repartition(2), most=50).collect()}
    want = Counter(int(x) for _, t in rows if t for x in word_hashes([t])[0].view(np.int64))
    assert got == dict(want)


def test_training_takes_whole_texts(spark):
    """Counts of long and short texts are those of one pass over all, without cuts."""
    d = docs(spark, [(i, prose(i, (3, 700, 40)[i % 3], 60)) for i in range(30)])
    vocab, counts = vocabulary(d, terms=30, shared=8)
    rows = [np.frombuffer(r.symbols, np.uint16) for r in encoded(d, vocab).collect()]
    fresh = HiddenMarkov.fresh(counts, 3, 0)
    first, moves, emitted, log = fresh.counted(np.concatenate(rows).astype(np.int64), np.array([len(x) for x in rows]))
    model, logs = train(encoded(d, vocab), counts, states=3, rounds=1)
    assert abs(logs[0] - log) < 1e-6 * abs(log) and np.allclose(model.start, (first + 0.1) / (first + 0.1).sum(), atol=1e-4)
    assert np.allclose(model.move, (moves + 0.1) / (moves + 0.1).sum(axis=1, keepdims=True), atol=1e-4)


def test_lm_hard_rows(spark):
    out = {(r.doc_id, r.n_words): r for r in lm_scores(odd(spark, HARD), terms=20, shared=8, rounds=1).collect()}
    assert out[(1, None)].log_likelihood is None
    assert out[(2, 0)].log_likelihood == 0.0 and out[(2, 0)].perplexity is None
    assert out[(9, 20_000)].perplexity < 100
    assert lm_scores(docs(spark, []), rounds=1).count() == 0


def test_licences(spark):
    noise = [(100 + i, f"a/b/n{i}.txt", prose(i, 50)) for i in range(30)]
    rows = [
        (1, "a/LICENSE", "Released under the MIT License."),
        (2, "a/b/c/x.py", prose(1, 80) + "\nLicensed under the Apache License, Version 2.0.\n" + prose(2, 80)),
        (3, "a/b/y.py", prose(3, 40)),
        (4, "z/q.py", prose(4, 40)),
        (5, "a/b/c/z.py", None),
        (6, None, "All rights reserved."),
        (7, None, prose(5, 20)),
        (8, "a/b/c/COPYING", "This work is licensed under the GNU General Public License, version 3.\n\n"),
        (9, "a/w.py", ""),
    ]
    d = spark.createDataFrame(rows + noise, "doc_id bigint, path string, text string")
    got = {r.doc_id: (r.license, r.via, r.from_path) for r in license_scan(d).collect()}
    assert len(got) == len(rows) + len(noise)
    assert got[1] == ("MIT", "own", None) and got[2] == ("Apache-2.0", "own", None)
    assert got[3] == ("MIT", "inherited", "a/LICENSE") and got[4] == (None, "none", None)
    assert got[5] == ("GPL-3.0", "inherited", "a/b/c/COPYING") and got[6][:2] == ("Proprietary", "own") and got[7][1] == "none" and got[9][0] == "MIT"
    assert got[100][0] == "MIT"
    assert license_scan(d.limit(0)).count() == 0


def test_licence_templates_find_themselves(spark):
    rows = [(k, f"d/f{k}", prose(k, 30, 3000) + "\n" + t + "\n" + prose(k + 500, 30, 3000), name) for k, (name, t) in enumerate((n, t) for n, ts in TEMPLATES.items() for t in ts)]
    d = spark.createDataFrame(rows, "doc_id bigint, path string, text string, want string")
    got = {r.doc_id: r.license for r in license_scan(d).collect()}
    assert [got[k] for k, _, _, _ in rows] == [w for _, _, _, w in rows]


def test_ancestors(spark):
    import pyspark.sql.functions as F

    got = spark.createDataFrame([("a/b/c",), ("",)], "f string").select(ancestors(F.col("f")).alias("a")).collect()
    assert got[0].a == ["", "a", "a/b", "a/b/c"] and got[1].a == [""]


def urls(n, seed):
    r, out = random.Random(seed), []
    for i in range(n):
        bad = int(r.random() < 0.4)
        host = f"{'win-' * bad}{r.choice('abcdef')}{r.randrange(9)}.example.{'biz' if bad else 'org'}"
        out.append((f"http{'s' * (1 - bad)}://{host}/" + "/".join(str(r.randrange(10**6)) for _ in range(1 + 2 * bad)) + ("?a=1&b=2&c=%20" if bad else ".html"), bad))
    return out


def test_url_filter_on_held_out_urls(spark):
    model = url_filter.train(spark.createDataFrame(urls(400, 1) + [(None, 1), ("http://x.example.org/", None)], "url string, bad int"), trees=5)
    held = urls(200, 2)
    out = {r.url: r.bad for r in url_filter.url_scores(spark.createDataFrame([(u,) for u, _ in held], "url string"), model).collect()}
    assert sum(out[u] == bool(y) for u, y in held) >= 0.95 * len(held)
    hard = [("", 1, 0.1), (None, 2, 0.1), ("not a url", 3, 0.1), ("http://", 4, 0.1), ("http://a.b/" + "x" * 50_000, 5, 0.1), ("//h/p?q", 6, 0.1), ("//h/p?q", 6, 0.1)]
    rows = url_filter.url_scores(spark.createDataFrame(hard, "url string, bad int, bad_score double"), model)
    assert rows.columns == ["url", "bad", "bad_score", "bad_score_1", "bad_1"] and rows.count() == len(hard)
    assert [r.bad_1 for r in rows.where("url IS NULL").collect()] == [False]
    assert url_filter.url_scores(spark.createDataFrame([], "url string"), model).count() == 0


def test_url_filter_with_one_class(spark):
    model = url_filter.train(spark.createDataFrame([("http://a.example/", 0)], "url string, bad int"))
    assert [r.bad_score for r in url_filter.url_scores(spark.createDataFrame([("x",), (None,)], "url string"), model).orderBy("url").collect()] == [None, 0.0]
    assert url_filter.train(spark.createDataFrame([], "url string, bad int")).base == 0.0


def test_url_features(spark):
    import pyspark.sql.functions as F

    u = "https://user@www.A.co.uk:80/x/y/1%20?b=1&c=2#f"
    f = spark.createDataFrame([(u,)], "u string").select(url_filter.host_of(F.col("u")).alias("host"), url_filter.suffix(url_filter.host_of(F.col("u")), 2).alias("s"), *[c.alias(n) for n, c in url_filter.lexical(F.col("u")).items()]).first()
    p = [u.count(c) / len(u) for c in set(u)]
    assert f.host == "a.co.uk" and f.s == "co.uk" and f.depth == 3 and f.params == 2 and f.fragment == 1 and f.secure == 1 and f.encoded == 1
    assert abs(f.entropy - -sum(x * math.log2(x) for x in p)) < 1e-9 and f.n_chars == len(u)


def brute_features(u):
    """The lexical features and suffixes of a URL, letter by letter."""
    v = u.strip(" ")
    rest, host = v, ""
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//", v)
    if m:
        authority = re.split(r"[/?#]", v[m.end() :])[0]
        rest = v[m.end() + len(authority) :]
        host = authority.split("@", 1)[1] if "@" in authority else authority
        host = host.split(":")[0].lower() if host and host[0] != ":" else ""
        host = re.sub(r"^www\.|\.$", "", host)
    path, _, query = re.split("#", rest)[0].partition("?")
    n = len(v)
    p = [v.count(c) / n for c in set(v)]
    return {
        "n_chars": n, "host_chars": len(host), "path_chars": len(path), "labels": len(host.split(".")), "depth": sum(x != "" for x in path.split("/")),
        "digit_ratio": sum(c in "0123456789" for c in v) / n if n else 0.0, "hyphens": v.count("-"), "entropy": -sum(x * math.log2(x) for x in p), "params": sum(x != "" for x in query.split("&")),
        "encoded": v.count("%"), "fragment": int("#" in v), "secure": int(v.lower().startswith("https:")),
    }, host


def test_url_features_and_rates_like_brute_force(spark):
    import pyspark.sql.functions as F

    r = random.Random(8)
    made = sorted({f"{r.choice(['http', 'HTTPS', 'ftp'])}://{r.choice(['', 'www.', 'u@'])}{r.choice('abc')}.{r.choice(['x-y', 'z'])}.{r.choice(['com', 'co.uk'])}{r.choice(['', ':80'])}/{'/'.join(r.choice(['p', '', 'q%20', '7']) for _ in range(r.randrange(4)))}{r.choice(['', '?a=1&&b=2', '?'])}{r.choice(['', '#f'])}" for _ in range(150)} | {"", "plain", "//h/p", "http://", "/only/path?x=1", "http://é.de/ü"})
    y = {u: int(r.random() < 0.5) for u in made}
    got = {x.url: x for x in spark.createDataFrame([(u,) for u in made], "url string").select("url", url_filter.host_of(F.col("url")).alias("host"), *[c.alias(n) for n, c in url_filter.lexical(F.col("url")).items()]).collect()}
    want = {u: brute_features(u) for u in made}
    for u in made:
        assert got[u].host == want[u][1], u
        assert all(abs(got[u][k] - v) < 1e-9 for k, v in want[u][0].items()), (u, want[u], got[u])
    # Rates that leave the own host out, from the counts of all hosts.
    d = spark.createDataFrame([(u, float(v)) for u, v in y.items()], "url string, label double")
    hosts = d.groupBy(url_filter.host_of(F.col("url")).alias("host")).agg(F.sum("label").alias("host_bad"), F.count(F.lit(1)).cast("double").alias("host_n"))
    base = sum(y.values()) / len(y)
    rows = url_filter._suffixes(url_filter._prepared(d, "url", "label").join(hosts, "host"), url_filter.suffix_counts(hosts), base, True).collect()
    end = lambda h, k: ".".join(h.split(".")[-k:])
    assert len(rows) == len(made)
    for x in rows:
        h = want[x.url][1]
        for k in (1, 2, 3):
            others = [v for u, v in y.items() if want[u][1] != h and end(want[u][1], k) == end(h, k)]
            assert abs(x[f"rate{k}"] - (sum(others) + 4 * base) / (len(others) + 4)) < 1e-9
            assert k == 1 or abs(x[f"seen{k}"] - math.log1p(len(others))) < 1e-9


def test_url_filter_on_hosts_it_never_saw(spark):
    r, rows = random.Random(9), []
    for i in range(600):
        bad = int(r.random() < 0.4)
        rows.append((f"http://{'win-' * bad}{r.choice('abcdefgh')}{r.randrange(40)}.example.com/" + "/".join(str(r.randrange(10**6)) for _ in range(1 + 2 * bad)), bad))
    assert url_filter.held_out_auc(spark.createDataFrame(rows, "url string, bad int"), trees=5) > 0.95
    one = url_filter.held_out_auc(spark.createDataFrame([("http://a.b/", 0)], "url string, bad int"))
    assert math.isnan(one)


def test_lowest_rows_are_the_first_by_hash(spark):
    import pyspark.sql.functions as F

    from kinfold.llm.common import lowest

    df = spark.range(20_000).select(F.col("id"), (F.col("id") % 3).alias("y"))
    want = {r.id for r in df.orderBy(F.pmod(F.xxhash64("id"), F.lit(1 << 40)), "id").limit(500).collect()}
    assert {r.id for r in lowest(df, "id", 500, 20_000).collect()} == want
    assert lowest(df, "id", 50_000, 20_000).count() == 20_000 and lowest(df.limit(0), "id", 5, 0).count() == 0


def brute_licences(rows, templates, header=0.7, whole=0.5):
    """Every line, every run of words and every whole text against every template, word by word."""
    texts = [t or "" for t in rows]
    df, n = Counter(w for t in texts for w in set(words(t))), len([t for t in rows if t is not None])
    weigh = lambda ws: {w: c * (math.log((1 + n) / (1 + df[w])) + 1) for w, c in Counter(ws).items()}

    def cosine(a, b):
        x, y = weigh(a), weigh(b)
        return sum(v * y.get(w, 0) for w, v in x.items()) / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values())) if x and y else 0.0

    known = [(name, words(t)) for name, ts in templates.items() for t in ts]
    out = []
    for t in texts:
        every = words(t)
        units = [(cosine(words(x), ws), name) for x in t.split("\n") for name, ws in known]
        units += [(cosine(every[i : i + len(ws)], ws), name) for name, ws in known for i in range(len(every))]
        best = max(units, default=(0, None))
        if best[0] >= header:
            out.append((round(best[0], 6), {name for c, name in units if c > best[0] - 1e-9}))
        else:
            c = max(((cosine(every, ws), name) for name, ws in known), default=(0, None))
            out.append((round(c[0], 6), {c[1]}) if c[0] >= whole else (None, {None}))
    return out


def test_licences_like_brute_force(spark):
    r, rows = random.Random(6), []
    told = [(n, t) for n, ts in TEMPLATES.items() for t in ts]
    for k in range(70):
        name, t = told[k % len(told)]
        ws = t.split()
        if k % 3 == 1:  # wrapped over lines
            size = r.randint(3, 8)
            t = "\n".join(" ".join(ws[i : i + size]) for i in range(0, len(ws), size))
        if k % 3 == 2:  # other words in it, repeated ones among them
            for _ in range(1 + len(ws) // 3):
                ws.insert(r.randrange(len(ws) + 1), r.choice(["same", "license", f"q{k}"]))
            t = " ".join(ws)
        rows.append((k, f"{prose(k, r.randint(0, 30), 2000)}{r.choice([' ', chr(10)])}{t}\n{prose(k + 500, r.randint(0, 60), 2000)}"))
    rows += [(100, None), (101, ""), (102, "!!!"), (103, "license " * 300), (104, "Licensed under the MIT License. " * 60), (105, rows[0][1])]
    d = spark.createDataFrame([(i, "p", t, "x", "y") for i, t in rows], "doc_id long, path string, text string, cosine string, folder string")
    got = {x.doc_id: x for x in license_texts(d).collect()}
    for (i, _), (cos, names) in zip(rows, brute_licences([t for _, t in rows], TEMPLATES), strict=True):
        assert got[i].license in names and (cos is None) == (got[i].cosine is None), (i, got[i], cos, names)
        assert cos is None or abs(got[i].cosine - cos) < 1e-5


def test_wrapped_notices_are_found(spark):
    mit, gpl = TEMPLATES["MIT"][2], TEMPLATES["GPL-3.0"][1]
    wrap = lambda t, k: "\n".join(f"# {' '.join(t.split()[i : i + k])}" for i in range(0, len(t.split()), k))
    rows = [(k, f"{wrap(t, k)}\n\n{prose(k, 1500, 3000)}") for k in (4, 7, 9) for t in (mit,)] + [(10 + k, f"{wrap(t, k)}\n\n{prose(k, 1500, 3000)}") for k in (4, 7, 9) for t in (gpl,)]
    d = spark.createDataFrame([(i, f"a/{i}", t) for i, t in rows], "doc_id long, path string, text string")
    got = {x.doc_id: x.license for x in license_texts(d).collect()}
    assert all(got[k] == "MIT" and got[10 + k] == "GPL-3.0" for k in (4, 7, 9))
