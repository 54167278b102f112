"""What the training-data operators share: column choice, row keys, checkpoints, batches."""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
import pyspark.sql.functions as F

from kinfold.session import checkpointed

WORD = re.compile(r"\w+")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def position(df: DataFrame, name: str) -> int:
    """Index of a column: the exact name first, else the only one that differs in case."""
    names = df.columns
    if name in names:
        return names.index(name)
    close = [i for i, n in enumerate(names) if n.lower() == name.lower()]
    if len(close) != 1:
        raise ValueError(f"no column {name!r} in {names}")
    return close[0]


def numbered(df: DataFrame) -> DataFrame:
    """The same rows with columns __c0, __c1, ...: no clash is possible, whatever the names were."""
    return df.toDF(*[f"__c{i}" for i in range(len(df.columns))])


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, as new=old; other columns, equal names included, don't matter."""
    at = {new: position(df, old) for new, old in columns.items()}
    return numbered(df).select(*[F.col(f"__c{i}").alias(new) for new, i in at.items()])


def row_key(*columns: Column) -> list[Column]:
    """Two 64-bit halves of a row's content key; NULL and the empty string differ."""
    parts = [x for c in columns for x in (c.isNull(), c)]
    return [F.xxhash64(F.lit(17), *parts).alias("__k1"), F.xxhash64(F.lit(71), *parts).alias("__k2")]


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder that the session names: it outlives any executor."""
    return checkpointed(df)


#: Letters of text that a worker takes at once: its arrays are many times their size.
LETTERS = 400_000


def slices(sizes: Sequence[int], budget: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows of about `budget` size together, at least one row each."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > budget:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], rows: int | None = 1_000) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same Arrow function over batches cut to `rows` rows, so that few texts are Python strings
    at once. When its task ends, the worker, which Spark keeps, gives memory back to the system."""

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, rows or max(1, b.num_rows)):
                yield b.slice(i, rows or b.num_rows)

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(small(batches))
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return wrapped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ODD = re.compile(r"[^\x00-\x7f\w]+")
LETTER = np.array([chr(b).isalnum() or b == 95 or b > 127 for b in range(256)])
LETTER[128:] = True
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the texts' words (as `words` finds them), end to end, and each text's number of them.

    All words of a batch are found and hashed by a few passes over its bytes: odd characters that
    are no letters become spaces, so what is left above ASCII is part of a word.
    """
    low = [t.lower() for t in texts]
    return _hashed([(t if t.isascii() else ODD.sub(" ", t)).encode("utf-8", "surrogatepass") for t in low])


def _hashed(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    whole = b"\n".join(raw) + b"\0" * 9
    letter = LETTER[np.frombuffer(whole, np.uint8)]
    edges = np.flatnonzero(letter[1:] != letter[:-1]) + 1
    if letter[0]:
        edges = np.append(0, edges)
    start, size = edges[::2], edges[1::2] - edges[::2]
    ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1)
    n = np.diff(np.searchsorted(start, ends), prepend=0)
    eight = np.ndarray((len(whole) - 7,), np.uint64, whole, strides=(1,))
    h = mixed(eight[start] & MASKS[np.minimum(size, 8)])
    left, step = np.flatnonzero(size > 8), 8
    while len(left):
        h[left] = mixed(h[left] * np.uint64(0x9E3779B97F4A7C15) + (eight[start[left] + step] & MASKS[np.minimum(size[left] - step, 8)]) + np.uint64(1))
        step += 8
        left = left[size[left] > step]
    return h, n


class Terms:
    """Words to numbers: known terms have places of their own, after a fixed number of buckets for all others."""

    def __init__(self, size: int, terms: Sequence[str] = (), hashes: np.ndarray | None = None):
        """The known terms, or their hashes as `word_hashes` makes them."""
        self.size = size
        self.hash = _hashed([t.encode("utf-8", "surrogatepass") for t in terms])[0] if hashes is None else hashes
        self.slots = 1 << max(10, (8 * len(self.hash)).bit_length())
        self.head, self.next = np.full(self.slots, -1, np.int32), np.full(len(self.hash), -1, np.int32)
        for i, slot in enumerate(((self.hash >> np.uint64(32)) & np.uint64(self.slots - 1)).astype(np.int64).tolist()):
            self.next[i], self.head[slot] = self.head[slot], i

    def places(self, h: np.ndarray) -> np.ndarray:
        out = (h & np.uint64(self.size - 1)).astype(np.int32)
        if not len(self.hash):
            return out
        at = self.head[((h >> np.uint64(32)) & np.uint64(self.slots - 1)).astype(np.int64)]
        left = np.flatnonzero(at >= 0)
        at = at[left]
        while len(left):
            same = self.hash[at] == h[left]
            out[left[same]] = self.size + at[same]
            at, left = self.next[at[~same]], left[~same]
            at, left = at[at >= 0], left[at >= 0]
        return out

    def tokens(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """All words' numbers in order and how many each text has."""
        h, n = word_hashes(texts)
        return self.places(h), n


ROWS = 512


def pieces(total: np.ndarray) -> pa.RecordBatch:
    """A task's array as (at, cells) pieces of `ROWS` rows, without those that are all zero."""
    flat = total.reshape(len(total), -1)
    at = [i for i in range(-(-len(flat) // ROWS)) if flat[i * ROWS : (i + 1) * ROWS].any()]
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([np.ascontiguousarray(flat[i * ROWS : (i + 1) * ROWS], np.float64).tobytes() for i in at], pa.binary())], names=["at", "cells"])


def summed(parts: DataFrame, shape: tuple[int, ...], fan: int = 64) -> np.ndarray:
    """The sum of all tasks' arrays, from their pieces.

    Pieces of one place are added in `fan` groups of tasks first, then the groups' sums. So a task
    gets tasks / fan pieces at most and the driver the one sum, however large the table is.
    """

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c.as_py(), np.float64) for c in t.column("cells"))
        return pa.table({"at": t.column("at").slice(0, 1), "cells": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros(shape)
    flat = out.reshape(shape[0], -1)
    some = parts.groupBy("at", (F.spark_partition_id() % fan).alias("group")).applyInArrow(add, "at int, cells binary")
    for r in some.groupBy("at").applyInArrow(add, "at int, cells binary").collect():
        piece = np.frombuffer(r["cells"], np.float64).reshape(-1, flat.shape[1])
        flat[r["at"] * ROWS : r["at"] * ROWS + len(piece)] = piece
    return out


BUCKETS = 1 << 18


def bucket_frequencies(docs: DataFrame, text: str, size: int = BUCKETS) -> tuple[np.ndarray, int]:
    """Of how many texts each word bucket has a word, over the whole table, and how many texts there are.

    Each task counts into one array of fixed size, which are then added up (see `summed`).
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = Terms(size), np.zeros(size + 1)
        for b in batches:
            texts = b.column("text").to_pylist()
            # At most 8,192 rows at once, so that row and bucket are one 31-bit number.
            for i, j in slices([max(len(t), 128) for t in texts], 1 << 20):
                at, n = known.tokens(texts[i:j])
                key = np.repeat(np.arange(j - i, dtype=np.int32) << np.int32(18), n) | at
                key.sort()
                total[:size] += np.bincount(key[np.flatnonzero(np.diff(key, prepend=-1))] & (size - 1), minlength=size)
            total[size] += len(texts)
        yield pieces(total)

    total = summed(pick(docs, text=text).where("text IS NOT NULL").mapInArrow(lean(count), "at int, cells binary"), (size + 1,))
    return total[:size], int(total[size])


def idf(df: np.ndarray, n: int) -> np.ndarray:
    return np.log((1 + n) / (1 + df)) + 1


def lowest(rows: DataFrame, key: str, most: int, total: int) -> DataFrame:
    """The `most` rows of the lowest hash of `key`, of `total`. Rows that can't be among them by a
    margin are left out first, so that few go to the task that orders them."""
    h = F.xxhash64(key)
    if total > most:
        room = (most + 6 * most**0.5 + 60) / total
        rows = rows.where(F.pmod(h, F.lit(1 << 40)) < int(min(1.0, room) * (1 << 40)))
    return rows.orderBy(F.pmod(h, F.lit(1 << 40)), key).limit(most)


def free_name(names: Sequence[str], wanted: str) -> str:
    """`wanted`, or with a number after it the first name that no column has."""
    taken, name, k = {n.lower() for n in names}, wanted, 0
    while name.lower() in taken:
        k += 1
        name = f"{wanted}_{k}"
    return name
