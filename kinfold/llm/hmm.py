"""Hidden Markov language model over words: Baum-Welch by partition, exact scaled forward scoring."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
import pyspark.sql.functions as F

from kinfold.llm.common import Terms, cut, pick, pieces, slices, summed, word_hashes, lean


class Vocabulary:
    """The corpus's most frequent words, a symbol each; the others share symbols by hash.

    A word in a shared symbol has its count's share of the symbol's probability: n / (total + 1),
    the one being for all words that the corpus hasn't. So word probabilities sum to one, and the
    table of counts, which has every word of the corpus, is part of the model (see `scored`). Words
    are told apart by a hash of 64 bits.
    """

    def __init__(self, hashes: np.ndarray, total: np.ndarray, counts: DataFrame):
        self.hashes, self.total, self.counts = hashes, total, counts
        self.size = len(total) + len(hashes)
        self.within = np.concatenate([-np.log(total + 1.0), np.zeros(len(hashes))])


def _tallied(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(h, kind="stable")
    h = h[order]
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.empty(0, np.int64)
    return h[first], np.add.reduceat(n[order], first) if len(h) else n


def word_counts(docs: DataFrame, text: str = "text", most: int = 500_000) -> DataFrame:
    """h, n: each word's hash and how often it is in the whole table. A task adds up its words, and
    sends them when it has `most` different ones, so a frequent word is sent few times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_h, held_n = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]

        def flush() -> pa.RecordBatch:
            h, n = _tallied(np.concatenate(held_h), np.concatenate(held_n))
            held_h[:], held_n[:] = [h], [n]
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

        for b in batches:
            texts = b.column("text").to_pylist()
            for i, j in slices([len(t) for t in texts], 2_000_000):
                h, n = np.unique(word_hashes(texts[i:j])[0], return_counts=True)
                held_h.append(h)
                held_n.append(n.astype(np.int64))
                if sum(map(len, held_h)) > 2 * most:
                    out = flush()
                    if out.num_rows > most:
                        held_h[:], held_n[:] = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
                        yield out
        yield flush()

    return pick(docs, text=text).where("text IS NOT NULL").mapInArrow(lean(run), "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))


def _most_frequent(counts: DataFrame, terms: int) -> list[Row]:
    """The words of the greatest counts, ties by hash. Their number is cut first by a histogram of
    sixteenths of an octave: so only they and the words of one class come to the driver, however many
    partitions there are."""
    octave = F.floor(F.log2("n") * 16).cast("int")
    sizes = {r["c"]: r["m"] for r in counts.groupBy(octave.alias("c")).agg(F.count(F.lit(1)).alias("m")).collect()}
    have, least = 0, 0
    for c in sorted(sizes, reverse=True):
        have, least = have + sizes[c], c
        if have >= terms:
            break
    rows = counts.where(octave >= least)
    edge = max(0, terms - (have - sizes.get(least, 0)))
    above, last = rows.where(octave > least), rows.where(octave == least).orderBy(F.desc("n"), "h").limit(edge)
    return sorted([*above.collect(), *last.collect()], key=lambda r: (-r["n"], r["h"]))


def vocabulary(docs: DataFrame, text: str = "text", terms: int = 32_768, shared: int = 4_096) -> tuple[Vocabulary, np.ndarray]:
    """The vocabulary and each symbol's count in the corpus. `shared` is a power of two, and there
    are at most 65,536 symbols, as they are kept in 16 bits."""
    if shared & (shared - 1) or shared < 1 or terms + shared > 65_536:
        raise ValueError("shared must be a power of two, and no more than 65536 symbols in all")
    counts = cut(word_counts(docs, text))
    top = _most_frequent(counts, terms)
    last = (top[-1]["n"], top[-1]["h"]) if top else (0, 0)
    rest = counts.where((F.col("n") < last[0]) | ((F.col("n") == last[0]) & (F.col("h") > last[1])))
    symbol = F.col("h").bitwiseAND(F.lit(shared - 1))
    total = np.zeros(shared)
    for r in rest.groupBy(symbol.alias("s")).agg(F.sum("n").alias("n")).collect():  # `shared` rows at most
        total[r["s"]] = r["n"]
    hashes = np.array([r["h"] for r in top], np.int64).view(np.uint64)
    return Vocabulary(hashes, total, rest), np.concatenate([total, [r["n"] for r in top]])


def encoded(docs: DataFrame, vocab: Vocabulary, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, the text's symbols as 16-bit numbers and the hashes of those of its words that share a
    symbol, NULL where the text is; `rid` numbers the rows, once the table is checkpointed."""
    d = pick(docs, doc_id=doc_id, text=text)
    shared, hashes = len(vocab.total), vocab.hashes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Terms(shared, hashes=hashes)
        for b in batches:
            texts = b.column("text").to_pylist()
            for i, j in slices([len(t or "") for t in texts], 2_000_000):
                h, n = word_hashes([t or "" for t in texts[i:j]])
                at = coder.places(h).astype(np.uint16)
                ends = np.append(0, np.cumsum(n))
                own = at < coder.size
                rare, rare_ends = h[own], np.append(0, np.cumsum(own))[ends]
                none = [t is None for t in texts[i:j]]
                cells = [None if x else at[ends[k] : ends[k + 1]].tobytes() for k, x in enumerate(none)]
                others = [None if x else rare[rare_ends[k] : rare_ends[k + 1]].tobytes() for k, x in enumerate(none)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), pa.array(cells, pa.binary()), pa.array(others, pa.binary())], names=["doc_id", "symbols", "rare"])

    made = d.mapInArrow(lean(run), f"doc_id {d.schema['doc_id'].dataType.simpleString()}, symbols binary, rare binary")
    return made.withColumn("rid", F.monotonically_increasing_id())


class HiddenMarkov:
    """Start, transition and emission probabilities."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit  # emit: symbols x states

    @classmethod
    def fresh(cls, counts: np.ndarray, states: int, seed: int) -> HiddenMarkov:
        rng = np.random.default_rng(seed)
        emit = (counts[:, None] + 0.1) * rng.uniform(0.5, 1.5, (len(counts), states))
        move = rng.uniform(0.5, 1.5, (states, states))
        return cls(np.full(states, 1 / states), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))

    def counted(self, flat: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected starts, moves and emissions of sequences (symbols end to end, lengths), and their
        log likelihood. All sequences advance together, the longest first, so that those still
        running are always the first ones."""
        k = len(self.start)
        order = np.argsort(-n, kind="stable")
        n, first = n[order], (np.cumsum(n) - n)[order]
        longest = int(n[0]) if len(n) else 0
        run = np.searchsorted(-n, -np.arange(1, longest + 1), side="right")  # running at each step
        ends = np.append(0, np.cumsum(run))
        at = np.concatenate([flat[first[:r] + t] for t, r in enumerate(run)]) if longest else flat[:0]
        emit, move, back = self.emit.astype(np.float32), self.move.astype(np.float32), np.ascontiguousarray(self.move.T, np.float32)
        seen = emit[at]
        alpha, log = np.empty((len(at), k), np.float32), 0.0
        a = None
        for t, r in enumerate(run):
            s = slice(ends[t], ends[t + 1])
            a = (self.start.astype(np.float32) if a is None else a[:r] @ move) * seen[s]
            c = a.sum(axis=1)
            a = a / c[:, None]
            alpha[s] = a
            seen[s] /= c[:, None]
            log += float(np.log(c.astype(np.float64)).sum())
        moves = np.zeros((k, k))
        gamma = alpha
        beta = np.ones((run[-1] if longest else 0, k), np.float32)
        for t in range(longest - 2, -1, -1):
            r, s = run[t + 1], slice(ends[t + 1], ends[t + 2])
            w = seen[s] * beta[:r]
            moves += alpha[ends[t] : ends[t] + r].T @ w
            gamma[s] *= beta[:r]
            beta = np.ones((run[t], k), np.float32)
            beta[:r] = w @ back
        if longest:
            gamma[: run[0]] *= beta
        emitted = np.stack([np.bincount(at, gamma[:, j], len(emit)) for j in range(k)], axis=1)
        return gamma[: run[0] if longest else 0].sum(axis=0, dtype=np.float64), moves * self.move, emitted, log

    def log_likelihood(self, flat: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Exact natural log likelihood of each sequence by the scaled forward recursion."""
        order = np.argsort(-n, kind="stable")
        sizes, first = n[order], (np.cumsum(n) - n)[order]
        longest = int(sizes[0]) if len(sizes) else 0
        run = np.searchsorted(-sizes, -np.arange(1, longest + 1), side="right")
        out = np.zeros(len(n))
        emit, move, a = self.emit, self.move, None
        for t, r in enumerate(run):
            a = (self.start if a is None else a[:r] @ move) * emit[flat[first[:r] + t]]
            c = a.sum(axis=1)
            a /= c[:, None]
            out[:r] += np.log(c)
        back = np.empty(len(n))
        back[order] = out
        return back


def _sequences(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[tuple[list[pa.RecordBatch], list[bytes | None]]]:
    """Batches put together up to about `budget` symbols."""
    held: list[pa.RecordBatch] = []
    cells: list[bytes | None] = []
    total = 0
    for b in batches:
        new = b.column("symbols").to_pylist()
        held.append(b)
        cells += new
        total += sum(len(c) // 2 for c in new if c)
        if total >= budget:
            yield held, cells
            held, cells, total = [], [], 0
    if held:
        yield held, cells


def _alike(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Whole texts, symbols end to end and lengths, in groups of about `budget` symbols whose lengths
    are within a factor of four of each other: so few steps are made for few texts."""
    held: dict[int, list[bytes]] = {}
    size: dict[int, int] = {}

    def taken(k: int) -> tuple[np.ndarray, np.ndarray]:
        cells = held.pop(k)
        size.pop(k)
        return np.frombuffer(b"".join(cells), np.uint16).astype(np.int64), np.array([len(c) // 2 for c in cells], np.int64)

    for b in batches:
        for c in b.column("symbols").to_pylist():
            if c:
                k = (len(c) // 2).bit_length() // 2
                held.setdefault(k, []).append(c)
                size[k] = size.get(k, 0) + len(c) // 2
                if size[k] >= budget:
                    yield taken(k)
    for k in sorted(held):
        yield taken(k)


def train(corpus: DataFrame, counts: np.ndarray, states: int = 8, rounds: int = 3, seed: int = 0) -> tuple[HiddenMarkov, list[float]]:
    """Baum-Welch over the encoded corpus, all of it in each round; the rounds' log likelihoods.

    A text is one sequence, whatever its length. Each task adds up its expected counts and sends
    them once; their sums have a fixed size.
    """
    model, logs, size = HiddenMarkov.fresh(counts, states, seed), [], len(counts)

    for _ in range(rounds):
        now = model

        def step(batches: Iterator[pa.RecordBatch], now: HiddenMarkov = now) -> Iterator[pa.RecordBatch]:
            total = np.zeros((size + states + 2, states))
            for flat, n in _alike(batches, 400_000):
                first, moves, emitted, log = now.counted(flat, n)
                total[:size] += emitted
                total[size : size + states] += moves
                total[-2] += first
                total[-1, 0] += log
            if total.any():
                yield pieces(total)

        got = summed(corpus.select("symbols").mapInArrow(lean(step), "at int, cells binary"), (size + states + 2, states))
        logs.append(float(got[-1, 0]))
        emit = got[:size] + 0.01
        move = got[size : size + states] + 0.1
        start = got[-2] + 0.1
        model = HiddenMarkov(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
    return model, logs


def rare_logs(corpus: DataFrame, counts: DataFrame) -> DataFrame:
    """rid, log_n: the sum of the logarithms of the counts of a row's words that share symbols, by a
    join with the table of all counts. Such a word is less frequent than any with a symbol of its
    own, so no key of the join is hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = b.column("rare").to_pylist()
            h = np.frombuffer(b"".join(cells), np.int64)
            own = np.repeat(b.column("rid").to_numpy(), [len(c) // 8 for c in cells])
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(h)], names=["rid", "h"])

    each = corpus.where("length(rare) > 0").select("rid", "rare").mapInArrow(lean(run), "rid bigint, h bigint")
    return each.join(counts, "h").groupBy("rid").agg(F.round(F.sum(F.ln("n")), 6).alias("log_n"))


def scored(corpus: DataFrame, model: HiddenMarkov, vocab: Vocabulary) -> DataFrame:
    kind, within = corpus.schema["doc_id"].dataType.simpleString(), vocab.within

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, cells in _sequences(batches, 2_000_000):
            n = np.array([len(c or b"") // 2 for c in cells], np.int64)
            flat = np.frombuffer(b"".join(c or b"" for c in cells), np.uint16)
            log = model.log_likelihood(flat, n)
            own = np.repeat(np.arange(len(n)), n)
            log += np.bincount(own, within[flat], len(n)) if len(flat) else 0
            none = np.array([c is None for c in cells], bool)
            ids, rid = (pa.chunked_array([b.column(c) for b in held]).combine_chunks() for c in ("doc_id", "rid"))
            yield pa.RecordBatch.from_arrays([ids, rid, pa.array(n, pa.int64(), mask=none), pa.array(log, pa.float64(), mask=none)], names=["doc_id", "rid", "n_words", "log"])

    base = corpus.select("doc_id", "rid", "symbols").mapInArrow(lean(run), f"doc_id {kind}, rid bigint, n_words bigint, log double")
    log = F.col("log") + F.coalesce("log_n", F.lit(0.0))
    out = base.join(rare_logs(corpus, vocab.counts), "rid", "left").select("doc_id", "n_words", log.alias("log_likelihood"))
    score = F.try_divide("log_likelihood", "n_words")
    return out.select("*", F.exp(-score).alias("perplexity"), score.alias("score"))


def lm_scores(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", states: int = 8, rounds: int = 3, terms: int = 32_768, shared: int = 4_096, seed: int = 0) -> DataFrame:
    """doc_id, `n_words`, `log_likelihood` (natural, of the whole text's words), `perplexity` a word
    and `score`, the log likelihood a word, one row for each row, by a model trained on the whole table.

    NULL text gives NULLs; a text without words has 0 words, log likelihood 0 and NULL perplexity
    and score. doc_id may be NULL or repeated and of any type; equal texts get equal scores. Other
    columns don't matter. Empty table: no rows. The encoded corpus is written once as a checkpoint,
    which training and scoring read; so is the table of all words' counts.
    """
    vocab, counts = vocabulary(docs, text, terms, shared)
    corpus = cut(encoded(docs, vocab, text, doc_id))
    model, _ = train(corpus, counts, states, rounds, seed=seed)
    return scored(corpus, model, vocab)
