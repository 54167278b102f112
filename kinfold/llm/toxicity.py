"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
import pyspark.sql.functions as F
from pyspark.sql.pandas.types import to_arrow_type

from kinfold.llm.common import WORD, cut, idf, lowest, numbered, pick, position, words, lean

BLOCK = 64


class Sparse(NamedTuple):
    """Rows of (term, value) cells, end to end: row i's are ends[i] to ends[i + 1], by term."""

    ends: np.ndarray
    term: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, rows: Sequence[Sequence[tuple[int, float]]]) -> Sparse:
        cells = [c for r in rows for c in sorted(r)]
        return cls(np.cumsum([0, *map(len, rows)]), np.array([t for t, _ in cells], np.int64), np.array([v for _, v in cells], np.float64))

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ends) - 1), np.diff(self.ends))

    def norms(self) -> np.ndarray:
        return np.sqrt(np.bincount(self.row, self.value**2, len(self.ends) - 1))


class BlockMaxIndex:
    """Inverted index of unit vectors whose postings lie in blocks with the greatest weight of each.

    Vectors are sorted, so that like ones share blocks. `search` visits blocks by their upper
    bound, the query times the blocks' greatest weights, and stops when no block left can reach the
    k-th similarity. So it is exact. Equal vectors are held once, with their examples. Only cells
    that aren't zero take room.
    """

    def __init__(self, vectors: Sparse, terms: int, ids: np.ndarray, labels: np.ndarray, block: int = BLOCK):
        """vectors: the examples', over so many terms. Examples of the zero vector are in no posting."""
        norm = vectors.norms()
        unit = np.round(vectors.value / np.maximum(norm, 1e-300)[vectors.row], 9)
        on = np.flatnonzero(norm > 0)
        cells = [tuple(zip(vectors.term[i:j].tolist(), unit[i:j].tolist(), strict=True)) for i, j in zip(vectors.ends[on].tolist(), vectors.ends[on + 1].tolist(), strict=True)]
        rank = np.argsort(np.argsort(ids[on], kind="stable"), kind="stable")
        order = sorted(range(len(on)), key=lambda i: (cells[i], rank[i]))
        self.ids, self.labels = ids[on][order], labels[on][order]
        new = np.array([k == 0 or cells[i] != cells[order[k - 1]] for k, i in enumerate(order)], bool)
        self.start = np.append(np.flatnonzero(new), len(order)).astype(np.int64)
        distinct = Sparse.of([cells[order[k]] for k in np.flatnonzero(new)])
        self.size = np.diff(self.start)
        self.votes = np.add.reduceat(self.labels, self.start[:-1]) if len(self.size) else np.empty(0)
        self.block, self.blocks = block, -(-len(self.size) // block)
        self.most = np.zeros((terms, self.blocks))
        np.maximum.at(self.most, (distinct.term, distinct.row // block), distinct.value)
        by_term = np.argsort(distinct.term, kind="stable")
        places, weights, heads = distinct.row[by_term], distinct.value[by_term], np.searchsorted(distinct.term[by_term], np.arange(terms + 1))
        self.postings = []  # per term: places and weights, and block bounds in them
        for t in range(terms):
            at = places[heads[t] : heads[t + 1]]
            self.postings.append((at, weights[heads[t] : heads[t + 1]], np.searchsorted(at, np.arange(self.blocks + 1) * block)))

    def _scores(self, blocks: np.ndarray, terms: Sequence[int], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in these blocks that have a term, and their cosines."""
        if len(blocks) > 4:  # whole postings are shorter work than many cuts of them
            score = np.zeros(self.blocks * self.block)
            for t, q in zip(terms, weights, strict=True):
                at, w, _ = self.postings[t]
                score[at] += q * w
            wanted = np.zeros(self.blocks, bool)
            wanted[blocks] = True
            hit = np.flatnonzero((score > 0) & np.repeat(wanted, self.block))
            return hit, np.round(score[hit], 9)
        found, cos = [], []
        for b in blocks:
            score = np.zeros(self.block)
            for t, q in zip(terms, weights, strict=True):
                at, w, cut = self.postings[t]
                s = slice(cut[b], cut[b + 1])
                score[at[s] - b * self.block] += q * w[s]
            hit = np.flatnonzero(score > 0)
            found.append(hit + b * self.block)
            cos.append(np.round(score[hit], 9))
        return np.concatenate(found) if found else np.empty(0, np.int64), np.concatenate(cos) if cos else np.empty(0)

    def search(self, terms: Sequence[int], weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the distinct vectors nearest to the query and their cosines, greatest first,
        with k examples or more between them; all that tie with the last come too.

        The blocks of the greatest bounds give a first k-th cosine; then only those whose bound
        reaches it are scored.
        """
        bound = weights @ self.most[list(terms)] if len(terms) else np.zeros(self.blocks)
        by_bound = np.argsort(-bound, kind="stable")
        by_bound = by_bound[bound[by_bound] > 0]
        place, cos, seen, have = np.empty(0, np.int64), np.empty(0), 0, 0
        while have < k and seen < len(by_bound):
            more, their = self._scores(by_bound[seen : seen + max(1, seen)], terms, weights)
            place, cos = np.concatenate([place, more]), np.concatenate([cos, their])
            seen += max(1, seen)
            have = int(self.size[place].sum())
        place, cos = self._top(place, cos, k)
        left = by_bound[seen:]
        left = left[bound[left] >= (cos[-1] if len(cos) else 0) - 1e-9]
        if len(left):
            more, their = self._scores(left, terms, weights)
            place, cos = self._top(np.concatenate([place, more]), np.concatenate([cos, their]), k)
        return place, cos

    def _top(self, place: np.ndarray, cos: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((place, -cos))
        reach = np.cumsum(self.size[place[order]])
        if len(reach) and reach[-1] >= k:
            order = order[cos[order] >= cos[order[np.searchsorted(reach, k)]]]
        return place[order], cos[order]


PREFIXES = range(3, 8)


def terms_of(word: str) -> list[str]:
    """The word and its proper prefixes of 3 to 7 letters (marked with ~): inflected and compounded
    forms share them."""
    return [word, *[word[:k] + "~" for k in PREFIXES if len(word) > k]]


class Lexicon(dict):
    """Word to the places of the lexicon's terms that it has, remembered as words come."""

    def __init__(self, terms: Sequence[str]):
        super().__init__()
        self.place = {t: i for i, t in enumerate(terms)}

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 400_000:
            self.clear()
        got = self[word] = tuple(self.place[t] for t in terms_of(word) if t in self.place)
        return got

    def __reduce__(self) -> tuple:
        return Lexicon, (list(self.place),)

    def counts(self, text: str) -> Counter[int]:
        """How often the text has each term."""
        return Counter(p for places in map(self.__getitem__, WORD.findall(text.lower())) if places for p in places)


def _isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pools adjacent violators: (least x of each pool, its weighted mean of y)."""
    order = np.argsort(x, kind="stable")
    xs, first = np.unique(x[order], return_index=True)
    pools: list[list[float]] = []
    for i, (v, m) in enumerate(zip(np.split((y * w)[order], first[1:]), np.split(w[order], first[1:]), strict=True)):
        pools.append([xs[i], float(v.sum()), float(m.sum())])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            _, s, n = pools.pop()
            pools[-1][1] += s
            pools[-1][2] += n
    return np.array([p[0] for p in pools]), np.array([p[1] / p[2] for p in pools])


class ToxicityModel:
    """Lexicon, term weights, example index and calibration; small enough to go with each task.

    A text's vector has its terms' TF-IDF and one more term that every text has once, whose weight
    is `common` times the examples' median norm: so one chance hit isn't as near to an example full
    of hits as their direction alone would have it. `share` weighs the classes' votes back to how
    often they are labelled. `examples` are each example's (term, count) cells.
    """

    def __init__(self, lexicon: list[str], weights: np.ndarray, examples: list[list[tuple[int, int]]], ids: np.ndarray, labels: np.ndarray, k: int, share: tuple[float, float] = (1.0, 1.0), common: float = 0.75):
        self.lexicon, self.weights, self.k, self.share = lexicon, weights, k, share
        self.words = Lexicon(lexicon)
        labels = labels.astype(np.float64)
        body = [[(t, n * float(weights[t])) for t, n in row] for row in examples]
        norms = Sparse.of(body).norms()
        self.common = common * float(np.median(norms[norms > 0])) if (norms > 0).any() else 1.0
        self.index = BlockMaxIndex(Sparse.of([[*row, (len(lexicon), self.common)] for row in body]), len(lexicon) + 1, ids, labels)
        each = np.where(labels > 0, share[1], share[0])
        self.base = float((each * labels).sum() / each.sum()) if len(labels) else 0.0
        self.found: dict[tuple, tuple] = {}
        self.told: dict[tuple, tuple] = {}
        # Calibration: each example is scored by the others.
        raw = [self._vote(tuple(sorted(row)), y) for row, y in zip(examples, labels, strict=True)]
        self.steps, self.levels = _isotonic(np.array(raw), labels, each) if raw else (np.zeros(1), np.zeros(1))
        self.found = {}

    def _query(self, q: tuple) -> tuple[list[int], np.ndarray]:
        terms = [t for t, _ in q]
        w = np.append(np.array([n for _, n in q], np.float64) * self.weights[terms] if q else [], self.common)
        return [*terms, len(self.lexicon)], w / np.linalg.norm(w)

    def _vote(self, q: tuple, without: float | None = None) -> float:
        """Votes by squared similarity, with one vote of the base rate. `without`: the label of the
        query's own example, which doesn't vote."""
        place, cos = self._near(q)
        w = cos**2
        yes = float(w @ self.index.votes[place])
        no = float(w @ self.index.size[place]) - yes
        if without is not None:
            yes, no = yes - without, no - (1 - without)
        yes, no = yes * self.share[1], no * self.share[0]
        return (yes + self.base) / (yes + no + 1)

    def _near(self, q: tuple) -> tuple[np.ndarray, np.ndarray]:
        got = self.found.get(q)
        if got is None:
            got = self.found[q] = self.index.search(*self._query(q), self.k)
            if len(self.found) > 50_000:
                self.found.clear()
        return got

    def key(self, text: str) -> tuple:
        return tuple(sorted(self.words.counts(text).items()))

    def score(self, text: str) -> float:
        """Calibrated chance that the text is toxic."""
        return self._score(self.key(text))

    def _score(self, q: tuple) -> float:
        v = self._vote(q)
        return float(self.levels[max(0, int(np.searchsorted(self.steps, v, side="right")) - 1)])

    def judged(self, text: str, most: int = 5) -> tuple[float, list[str], list[dict]]:
        """The score, the text's terms and its nearest examples, lowest id first among equal cosines."""
        q = self.key(text)
        got = self.told.get(q)
        if got is None:
            if len(self.told) > 50_000:
                self.told.clear()
            got = self.told[q] = (self._score(q), *(self._evidence(q, most) if q else ([], [])))
        return got

    def _evidence(self, q: tuple, most: int) -> tuple[list[str], list[dict]]:
        place, cos = self._near(q)
        out: list[dict] = []
        for c in np.unique(-cos):
            own = np.concatenate([np.arange(self.index.start[p], self.index.start[p + 1]) for p in place[cos == -c]])
            for e in own[np.argsort(self.index.ids[own], kind="stable")][: most - len(out)].tolist():
                out.append({"doc_id": self.index.ids[e], "toxic": int(self.index.labels[e]), "cosine": float(-c)})
            if len(out) >= most:
                break
        return [self.lexicon[t] for t, _ in q], out


def _group(ws: list[str]) -> int:
    """The least hash of runs of three words, which near copies mostly share."""
    runs = zip(ws, ws[1:], ws[2:], strict=False) if len(ws) > 2 else [tuple(ws)]
    return min(xxhash.xxh3_64_intdigest(" ".join(r)) for r in runs) >> 1


def lexicon_counts(docs: DataFrame, lexicon: Sequence[str], text: str = "text") -> tuple[np.ndarray, int]:
    """Of how many texts of the whole table has each term, and how many texts there are."""
    known = Lexicon(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(lexicon) + 1, np.int64), 0
        for b in batches:
            for t in b.column("text").to_pylist():
                for w in known.counts(t):
                    total[w] += 1
                n += 1
        total[-1] = n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["term", "n"])

    rows = pick(docs, text=text).where("text IS NOT NULL").mapInArrow(lean(run), "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(lexicon) + 1, np.int64)
    for r in rows:
        out[r["term"]] = r["n"]
    return out[:-1], int(out[-1])


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", k: int = 15, per_class: int = 5_000, doubt: float = 0.01, most_terms: int = 20_000) -> ToxicityModel:
    """The model from labelled rows.

    Examples are at most `per_class` labelled rows of each class, the lowest by hash of their id:
    the documented bound of the training sample; all of them vote. A term (a word or a prefix) is in
    the lexicon if its presence tells the classes apart, by chi-square at `doubt` over the number of
    terms tried; of more than `most_terms` those of the greatest chi-square are, ties by term. For
    chi-square, rows with the same least hash of three-word runs count as one, which has a term if
    one of them has: so a passage that is copied often doesn't make a lexicon of its words.
    Document frequencies for TF-IDF are over the whole table. Labels or ids that are NULL, and
    labelled ids without a text or a word, are left out; a row with two labels is toxic if one is;
    an id with several texts gives an example for each. Ids may be of any type that orders.
    """
    told = pick(labels, id=doc_id, y=label).where("id IS NOT NULL AND y IS NOT NULL").groupBy("id").agg(F.max(F.col("y").cast("int")).alias("y"))
    labelled = {r["y"]: r["n"] for r in told.groupBy((F.col("y") > 0).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    some = lowest(told.where("y > 0"), "id", per_class, labelled.get(1, 0)).union(lowest(told.where("y <= 0"), "id", per_class, labelled.get(0, 0)))
    d = pick(docs, id=doc_id, text=text)
    kind = d.schema["id"].dataType.simpleString()
    texts = d.where("text IS NOT NULL").join(F.broadcast(some), "id")  # at most 2 x per_class ids

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [words(t) for t in b.column("text").to_pylist()]
            b = b.append_column("g", pa.array([_group(w) if w else None for w in found], pa.int64()))
            yield b.filter(b.column("g").is_valid())

    held = cut(texts.select("id", (F.col("y") > 0).cast("int").alias("y"), "text").mapInArrow(lean(grouped), f"id {kind}, y int, text string, g bigint"))
    totals = {r["y"]: (r["n"], r["m"]) for r in held.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("g").alias("m")).collect()}
    pos, neg = (totals.get(y, (0, 0))[1] for y in (1, 0))
    lexicon: list[str] = []
    if pos and neg:

        def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                own = [sorted({x for w in set(words(t)) for x in terms_of(w)}) for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("g"), b.column("y"), pa.array(own, pa.list_(pa.string()))], names=["g", "y", "terms"])

        each = held.select("g", "y", "text").mapInArrow(lean(terms), "g bigint, y int, terms array<string>").select("g", "y", F.explode("terms").alias("term"))
        seen = cut(each.distinct().groupBy("term").agg(F.count_if(F.col("y") == 1).alias("a"), F.count(F.lit(1)).alias("m")))
        tried = seen.count()
        n, a, m = float(pos + neg), F.col("a").cast("double"), F.col("m").cast("double")
        off = a * (neg - (m - a)) - (m - a) * (pos - a)  # determinant of the 2 x 2 table
        chi = F.try_divide(off * off * n, float(pos) * neg * m * (n - m))
        least = 2 * float(np.log(tried / doubt))
        lexicon = sorted(r["term"] for r in seen.where((m > 1) & (chi >= least)).orderBy(chi.desc(), "term").limit(most_terms).select("term").collect())
    known = Lexicon(lexicon)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sorted(known.counts(t).items()) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("y"), pa.array([[p for p, _ in f] for f in found], pa.list_(pa.int32())), pa.array([[c for _, c in f] for f in found], pa.list_(pa.int32()))], names=["id", "y", "at", "n"])

    rows = held.select("id", "y", "text").mapInArrow(lean(counted), f"id {kind}, y int, at array<int>, n array<int>").orderBy("id", "y", "at", "n").collect()
    rates = [labelled.get(y, 0) / n if (n := totals.get(y, (0, 0))[0]) else 0.0 for y in (0, 1)]
    share = (1.0, rates[1] / rates[0]) if rates[0] and rates[1] else (1.0, 1.0)
    df, texts_n = lexicon_counts(docs, lexicon, text) if lexicon else (np.empty(0), 0)
    ids = np.empty(len(rows), object)
    ids[:] = [r["id"] for r in rows]
    return ToxicityModel(lexicon, idf(df, texts_n), [list(zip(r["at"], r["n"], strict=True)) for r in rows], ids, np.array([r["y"] for r in rows], np.float64), k, share)


def toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", doc_id: str = "doc_id", reject: float = 0.5) -> DataFrame:
    """doc_id, `score`, `toxic` (score >= reject), the lexicon `terms` it has and its nearest
    labelled `neighbours` (doc_id, toxic, cosine), one row for each row of the table.

    NULL text has a NULL score, isn't toxic and has no neighbours; a text without words or terms is
    scored by the examples that have none, and shows no neighbours. Ties in similarity all vote.
    doc_id may be NULL, repeated and of any type that orders, the same as the labels'. Repeated rows
    get equal results. Empty table: no rows. Whole texts count, whatever their length.
    """
    d = pick(docs, doc_id=doc_id, text=text)
    near = pa.list_(pa.struct([("doc_id", to_arrow_type(d.schema["doc_id"].dataType)), ("toxic", pa.int32()), ("cosine", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            why = [(None, [], []) if t is None else model.judged(t) for t in texts]
            score = [w[0] for w in why]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(score, pa.float64()), pa.array([s is not None and s >= reject for s in score], pa.bool_()), pa.array([w[1] for w in why], pa.list_(pa.string())), pa.array([w[2] for w in why], near)],
                names=["doc_id", "score", "toxic", "terms", "neighbours"],
            )

    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(lean(run), f"doc_id {kind}, score double, toxic boolean, terms array<string>, neighbours array<struct<doc_id: {kind}, toxic: int, cosine: double>>")


def drop_toxic(docs: DataFrame, model: ToxicityModel, text: str = "text", reject: float = 0.5) -> DataFrame:
    """The table without the rows that the model rejects; all columns stay as they are, whatever
    their names, and rows whose text is NULL stay."""
    at = position(docs, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stays = [t is None or model.score(t) < reject for t in b.column(at).to_pylist()]
            yield b.filter(pa.array(stays, pa.bool_()))

    rows = numbered(docs)
    return rows.mapInArrow(lean(run), rows.schema).toDF(*docs.columns)
