"""MinHash near-dedup with HyperMinHash registers."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
import pyspark.sql.functions as F

from kinfold.llm.common import LETTERS, cut, numbered, pick, position, row_key, slices, word_hashes, lean
from kinfold.operators.graph import connected_components

BUCKETS = 128
MANTISSA = 10
REST = 52
EMPTY = np.uint16(0xFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words and the row of each; a shorter text is one shingle, a text without words none."""
    flat, n = word_hashes(texts)
    row = np.repeat(np.arange(len(n)), n)
    start = np.cumsum(n) - n
    at = np.arange(len(flat)) - start[row]
    h = np.zeros(len(flat), np.uint64)
    for j in range(size):
        step = np.zeros(len(flat), np.uint64)
        if j < len(flat):
            step[: len(flat) - j] = flat[j:]
        if j:
            step[at + j >= n[row]] = 0
        h = h * np.uint64(0x9E3779B97F4A7C15) + step
    whole = (at + size <= n[row]) | (at == 0)
    return _mix(h[whole]), row[whole]


def registers(h: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """rows x BUCKETS registers of 16 bits: the count of leading zeros of the bucket's least hash
    (6 bits) and the MANTISSA bits after its first one. EMPTY where no shingle fell."""
    least = np.full(rows * BUCKETS, 1 << REST, np.uint64)
    bucket = (h >> np.uint64(57)).astype(np.int64)
    rest = (h << np.uint64(7)) >> np.uint64(64 - REST)
    np.minimum.at(least, row * BUCKETS + bucket, np.maximum(rest, np.uint64(1)))
    bits = least.astype(np.float64).view(np.uint64)
    zeros = np.uint64(1023 + REST - 1) - (bits >> np.uint64(52))
    mantissa = (bits >> np.uint64(52 - MANTISSA)) & np.uint64((1 << MANTISSA) - 1)
    out = ((zeros << np.uint64(MANTISSA)) | mantissa).astype(np.uint16)
    out[least == np.uint64(1 << REST)] = EMPTY
    return out.reshape(rows, BUCKETS)


def densify(reg: np.ndarray) -> np.ndarray:
    """Each empty register takes the value of a full one, chosen by a hash that depends only on the
    bucket and the attempt, so two rows with like registers borrow alike."""
    out = reg.copy()
    todo = np.flatnonzero((reg == EMPTY).any(axis=1) & (reg != EMPTY).any(axis=1))
    attempt = 0
    while len(todo):
        attempt += 1
        source = (_mix(np.arange(BUCKETS, dtype=np.uint64) + np.uint64(attempt * 1_000_003)) % np.uint64(BUCKETS)).astype(np.int64)
        got = reg[todo][:, source]
        hole = out[todo] == EMPTY
        out[todo] = np.where(hole, got, out[todo])
        todo = todo[(out[todo] == EMPTY).any(axis=1)]
    return out


#: The value that a register stands for, in the middle of its cell: a share of the bucket's range.
VALUE = np.ones(1 << 16, np.float32)
VALUE[: REST << MANTISSA] = [(1 + (r % (1 << MANTISSA) + 0.5) / (1 << MANTISSA)) * 2.0 ** -(r >> MANTISSA) / 2 for r in range(REST << MANTISSA)]
STEPS = np.arange(-8, 25)  # loads in the table of collisions, as powers of two


LOADS = 2.0 ** np.linspace(-12, 30, 1000)
MEANS = -np.expm1(-LOADS) / LOADS  # of the least of a Poisson number of hashes, 1 for none


def load(reg: np.ndarray) -> np.ndarray:
    """Shingles a bucket, estimated from a row's registers: from the mean of the values they stand for."""
    return np.interp(-VALUE[reg].mean(axis=-1, dtype=np.float64), -MEANS, LOADS)


def _collisions() -> np.ndarray:
    """How often registers of two sets without a common shingle agree, by the loads of either: for each
    cell that a register tells apart, the chance that both least hashes fall in it."""
    octave = np.arange(REST - 1)
    edge = np.append(0, np.sort(np.concatenate([2.0 ** -(octave + 1) * (1 + m / 32) for m in range(32)] + [[1.0]])))
    n = 2.0**STEPS
    # Cells are summed 32 to an octave; within one, 2^MANTISSA / 32 cells share the chance evenly.
    fall = np.diff(-np.exp(-n[:, None] * edge), axis=1)
    return (fall @ fall.T) / (2**MANTISSA / 32)


CHANCE = _collisions()


def chance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of registers that agree by chance, for sets of these loads."""
    i, j = (np.clip(np.rint(np.log2(np.maximum(x, 1e-9))) - STEPS[0], 0, len(STEPS) - 1).astype(np.int64) for x in (a, b))
    return CHANCE[i, j]


def jaccard(a: np.ndarray, b: np.ndarray, loads: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Collision-corrected estimate for rows of registers: agreements over registers that either
    has, less the share that agrees by chance at the sets' sizes, which the registers give too."""
    used = (a != EMPTY) | (b != EMPTY)
    n = np.maximum(used.sum(axis=-1), 1)
    raw = ((a == b) & used).sum(axis=-1) / n
    c = chance(*(loads or (load(a), load(b))))
    return np.clip((raw - c) / (1 - c), 0, 1)


def sketch(docs: DataFrame, text: str, doc_id: str, size: int) -> DataFrame:
    """k1, k2 (row key), id, reg (registers) and digest (of its shingle set) for each row with a word in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            for i, j in slices([len(t) for t in texts], LETTERS):
                h, row = shingles(texts[i:j], size)
                reg = registers(h, row, j - i)
                full = np.flatnonzero((reg != EMPTY).any(axis=1))
                part = b.slice(i, j - i).take(pa.array(full))
                ends = np.searchsorted(row, np.arange(j - i + 1))
                digest = [blake2b(np.unique(h[ends[k] : ends[k + 1]]).tobytes(), digest_size=16).digest() for k in full.tolist()]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in ("k1", "k2", "id")] + [pa.array([r.tobytes() for r in reg[full]], pa.binary()), pa.array(digest, pa.binary())], names=["k1", "k2", "id", "reg", "digest"])

    d = pick(docs, id=doc_id, text=text).where("text IS NOT NULL")
    d = d.select(*[k.alias(n) for k, n in zip(row_key(F.col("id"), F.col("text")), ("k1", "k2"), strict=True)], "id", "text")
    return d.mapInArrow(lean(run), f"k1 bigint, k2 bigint, id {d.schema['id'].dataType.simpleString()}, reg binary, digest binary")


def band_rows(heads: DataFrame, rows: int) -> DataFrame:
    """head and key for each band of each distinct sketch, over densified registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            reg = densify(np.frombuffer(b"".join(b.column("reg").to_pylist()), np.uint16).reshape(-1, BUCKETS))
            words = reg.reshape(len(reg), BUCKETS // rows, rows).astype(np.uint64)
            h = np.broadcast_to(np.arange(BUCKETS // rows, dtype=np.uint64) + np.uint64(1), words.shape[:2]).copy()
            for j in range(rows):
                h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + words[:, :, j])
            head = np.repeat(b.column("head").to_numpy(), h.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(head), pa.array(h.reshape(-1).view(np.int64))], names=["head", "band"])

    return heads.select("head", "reg").mapInArrow(lean(run), "head bigint, band bigint")


def _leaders(t: pa.Table, least: float) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Leader clustering of one band's sketches: the first that is left leads, all that it estimates
    to be near join it and the rest go on, until none is left. Nothing is capped."""
    head = t.column("head").to_numpy()
    order = np.argsort(head, kind="stable")
    head = head[order]
    reg = np.frombuffer(b"".join(t.column("reg").to_pylist()), np.uint16).reshape(-1, BUCKETS)[order]
    left, n = np.arange(len(head)), load(reg)
    out = []
    while len(left):
        near = jaccard(reg[left], reg[left[0]], (n[left], n[left[0]]))
        hit = near >= least
        hit[0] = True
        out.append((head[left[0]], left[hit], near[hit]))
        left = left[~hit]
    return [(order[m[0]], head[m], e) for _, m, e in out]


def shared_bands(heads: DataFrame, rows: int) -> DataFrame:
    """band, head, n: the bands that n > 1 sketches share."""
    bands = band_rows(heads, rows)
    size = bands.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return bands.join(size, "band").select("band", "head", "n")


def candidates(heads: DataFrame, shared: DataFrame, least: float, chunk: int = 4096) -> DataFrame:
    """Distinct pairs (a, b) of sketches, a leader of a band and one that is estimated near it.

    A band is clustered in parts of about `chunk` sketches, then its parts' leaders among
    themselves, so a band that very many documents share needs no large task. These pairs link
    most copies; `unlinked` gives those that remain.
    """
    schema = "a bigint, b bigint, lead boolean, band bigint, reg binary"
    part = F.pmod(F.xxhash64("head"), F.ceil(F.col("n") / chunk)).cast("int")
    rich = shared.select("band", "head", "n", part.alias("part")).join(heads.select("head", "reg"), "head")

    def cluster(t: pa.Table) -> pa.Table:
        band, big = t.column("band"), t.column("n")[0].as_py() > chunk
        a, b, lead, reg = [], [], [], []
        for at, members, _ in _leaders(t, least):
            first = t.column("head")[int(at)].as_py()
            others = members[members != first]
            a += [first] * len(others)
            b += others.tolist()
            lead += [False] * len(others)
            reg += [None] * len(others)
            if big:
                a.append(first)
                b.append(first)
                lead.append(True)
                reg.append(t.column("reg")[int(at)].as_py())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "lead": pa.array(lead, pa.bool_()), "band": pa.array([band[0].as_py()] * len(a), pa.int64()), "reg": pa.array(reg, pa.binary())})

    one = cut(rich.groupBy("band", "part").applyInArrow(cluster, schema))
    top = one.where("lead").select("band", F.col("a").alias("head"), "reg", F.lit(0).alias("n"), F.lit(0).alias("part"))
    two = top.groupBy("band").applyInArrow(cluster, schema)
    return one.where("NOT lead").unionByName(two).select("a", "b").distinct()


def unlinked(heads: DataFrame, shared: DataFrame, roots: DataFrame, least: float, chunk: int = 4096) -> DataFrame:
    """Distinct pairs (a, b), a < b, of sketches that share a band, are estimated near and aren't in
    one component yet. `roots`: node, root; a sketch without one is its own.

    Bands that lie in one component are passed over. A band of more than `chunk` sketches is
    split in parts, and each two parts meet in a task of their own.
    """
    rooted = shared.join(roots, F.col("head") == F.col("node"), "left").select("band", "head", "n", F.coalesce("root", "head").alias("root"))
    mixed = rooted.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("band")
    parts = F.ceil(F.col("n") / chunk).cast("int")
    own = rooted.join(mixed, "band").select("band", "head", "root", parts.alias("parts"), F.pmod(F.xxhash64("head"), parts).cast("int").alias("p"))
    each = own.select("band", "head", "root", "p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("q"))
    placed = each.select("band", "head", "root", "p", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"))
    rich = placed.join(heads.select("head", "reg"), "head")

    def compare(t: pa.Table) -> pa.Table:
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        _, root, size = np.unique(t.column("root").to_numpy(), return_inverse=True, return_counts=True)
        order = np.lexsort((root, size[root]))  # the largest component last: its rows are only compared with others'
        head, root, p = t.column("head").to_numpy()[order], root[order], t.column("p").to_numpy()[order]
        reg = np.frombuffer(b"".join(t.column("reg").to_pylist()), np.uint16).reshape(-1, BUCKETS)[order]
        end = np.append(np.flatnonzero(np.diff(root)) + 1, len(root))
        later = end[np.searchsorted(end, np.arange(len(root)), side="right")]
        a, b, n = [], [], load(reg)
        for k in range(len(root)):
            rest = np.arange(later[k], len(root))
            if i != j:
                rest = rest[p[rest] != p[k]]
            hit = rest[jaccard(reg[rest], reg[k], (n[rest], n[k])) >= least]
            a.append(np.minimum(head[hit], head[k]))
            b.append(np.maximum(head[hit], head[k]))
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return rich.groupBy("band", "i", "j").applyInArrow(compare, "a bigint, b bigint").distinct()


def verified(pairs: DataFrame, texts: DataFrame, threshold: float, size: int) -> DataFrame:
    """The pairs whose shingle sets, taken from the whole texts, have Jaccard of the threshold or more.

    Each set goes as sorted 64-bit hashes to its pairs, grouped by the pair's first member.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = b.column("text").to_pylist()
            for i, j in slices([len(x) for x in t], LETTERS):
                h, row = shingles(t[i:j], size)
                ends = np.searchsorted(row, np.arange(j - i + 1))
                cells = [np.unique(h[ends[k] : ends[k + 1]]).tobytes() for k in range(j - i)]
                yield pa.RecordBatch.from_arrays([b.column("head").slice(i, j - i), pa.array(cells, pa.binary())], names=["head", "cells"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("x"), b.column("y"), strict=True):
                p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(both / max(1, len(p) + len(q) - both))
            near = np.array(keep, np.float64)
            ok = pa.array(near >= threshold)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(ok), b.column("b").filter(ok), pa.array(near).filter(ok)], names=["a", "b", "jaccard"])

    members = pairs.select(F.explode(F.array("a", "b")).alias("head")).distinct()
    held = cut(texts.join(members, "head", "left_semi").mapInArrow(lean(sets), "head bigint, cells binary"))
    x, y = held.toDF("a", "x"), held.toDF("b", "y")
    return pairs.join(x, "a").join(y, "b").mapInArrow(lean(check), "a bigint, b bigint, jaccard double")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that each is linked to. No step gathers a node's neighbours."""
    e = cut(edges.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    nodes = e.select(F.explode(F.array("src", "dst")).alias("id"))
    return connected_components(nodes, e).select(F.col("id").alias("node"), F.col("component").alias("root"))


def near_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = 0.55, size: int = 3, rows: int = 4, slack: float = 0.15) -> DataFrame:
    """k1, k2, doc_id, group_id, keep: the rows that have a near copy, by group.

    Registers are made once a row; rows whose sets of runs of `size` words are equal, by a digest of
    128 bits, are one sketch. Sets that only agree in their registers are compared as others are. Bands of `rows`
    registers give candidates, those estimated at `threshold - slack` or more are compared on
    their exact sets of runs of `size` words, and the pairs that pass link groups: first pairs
    with a leader of their band, then all others of a band that aren't linked yet. Of a group the
    row with the lowest doc_id stays (NULL last, ties by content); group_id is its doc_id. Rows
    with NULL text or no word are in no group; repeated equal rows are in one. Ids may be of any
    type that orders; other columns don't matter; an empty table has no groups.
    """
    rows_ = sketch(docs, text, doc_id, size)
    head = F.struct(F.col("id").isNull(), "id", "k1", "k2")
    made = cut(rows_)
    same = made.groupBy("digest", "reg").agg(F.min(head).alias("h"), F.count(F.lit(1)).alias("n"))
    heads = cut(same.select(F.xxhash64("digest").alias("head"), "digest", "reg", "h", "n"))
    shared = cut(shared_bands(heads, rows))
    first = heads.select(F.col("h.k1").alias("k1"), F.col("h.k2").alias("k2"), "head")
    d = pick(docs, id=doc_id, text=text).where("text IS NOT NULL")
    keyed = d.select(*[k.alias(n) for k, n in zip(row_key(F.col("id"), F.col("text")), ("k1", "k2"), strict=True)], "text")

    def passed(pairs: DataFrame) -> DataFrame:
        asked = first.join(pairs.select(F.explode(F.array("a", "b")).alias("head")).distinct(), "head", "left_semi")
        texts = keyed.join(asked, ["k1", "k2"]).dropDuplicates(["head"]).select("head", "text")
        return verified(pairs, texts, threshold, size).select("a", "b")

    near = cut(passed(cut(candidates(heads, shared, threshold - slack))))
    roots = cut(components(near))
    more = passed(cut(unlinked(heads, shared, roots, threshold - slack)))
    links = components(near.unionByName(more))
    rooted = heads.join(links, heads["head"] == links["node"], "left").select("digest", F.coalesce("root", "head").alias("root"), "n", "h")
    group = rooted.groupBy("root").agg(F.min("h").alias("best"), F.sum("n").alias("n")).where("n > 1")
    member = rooted.select("digest", "root").join(group, "root").select("digest", "best")
    return made.drop("reg").join(member, "digest").select(
        "k1", "k2", F.col("id").alias("doc_id"), F.col("best.id").alias("group_id"),
        ((F.col("k1") == F.col("best.k1")) & (F.col("k2") == F.col("best.k2"))).alias("keep"),
    )


def near_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **how: float) -> DataFrame:
    """The table with one row of each group of near copies (see `near_groups`), all columns as they were."""
    names, i, t = docs.columns, position(docs, doc_id), position(docs, text)
    out = near_groups(docs, text, doc_id, **how).groupBy(F.col("k1").alias("__k1"), F.col("k2").alias("__k2")).agg(F.bool_or("keep").alias("__keep"))
    again = F.row_number().over(Window.partitionBy("__k1", "__k2").orderBy("__k1"))
    rows = numbered(docs).select("*", *row_key(F.col(f"__c{i}"), F.col(f"__c{t}"))).withColumn("__rn", again)
    left = rows.join(out, ["__k1", "__k2"], "left").where("__keep IS NULL OR (__keep AND __rn = 1)")
    return left.select(*[f"__c{k}" for k in range(len(names))]).toDF(*names)
