"""Reversible line dedup: sharded cuckoo filters over exact reference-count tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
import pyspark.sql.functions as F
import pyspark.sql.types as T

from kinfold.llm.common import cut, numbered, pick, position, row_key, lean

SLOTS = 4
KICKS = 500


class CuckooFilter:
    """Partial-key cuckoo filter of 16-bit fingerprints, four to a bucket, over 64-bit keys.

    `insert` and `remove` take arrays. Equal keys are the caller's to count: each key that is in
    the filter is there once. When an insertion finds no room the filter doubles and is built
    anew from `keys`, so it needs the exact table, which is always at hand.
    """

    def __init__(self, buckets: int, cells: np.ndarray | None = None):
        self.buckets = buckets
        self.cells = np.zeros((buckets, SLOTS), np.uint16) if cells is None else cells.reshape(buckets, SLOTS)

    @staticmethod
    def sized(n: int) -> int:
        return 1 << max(3, int(np.ceil(np.log2(max(1, n) / (SLOTS * 0.8)))))

    @staticmethod
    def mix(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = self.mix(keys.astype(np.int64).view(np.uint64))
        mark = ((h >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        one = (h & np.uint64(self.buckets - 1)).astype(np.int64)
        return mark, one, self._other(one, mark)

    def _other(self, at: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return at ^ (self.mix(np.asarray(mark).astype(np.uint64)) & np.uint64(self.buckets - 1)).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        mark, one, two = self._places(keys)
        return ((self.cells[one] == mark[:, None]) | (self.cells[two] == mark[:, None])).any(axis=1)

    def _settle(self, at: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """Puts each mark in a free slot of its bucket where there is one; says which were left."""
        left = np.arange(len(at))
        for slot in range(SLOTS):
            free = left[self.cells[at[left], slot] == 0]
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.cells[at[put], slot] = mark[put]
            left = np.setdiff1d(left, put, assume_unique=True)
        return left

    def insert(self, keys: np.ndarray) -> bool:
        mark, one, two = self._places(keys)
        left = self._settle(one, mark)
        left = left[self._settle(two[left], mark[left])]
        for i in left:
            at, m = int(two[i]), mark[i]
            for kick in range(KICKS):
                free = np.flatnonzero(self.cells[at] == 0)
                if len(free):
                    self.cells[at, free[0]] = m
                    break
                slot = (kick * 7 + int(m)) % SLOTS
                self.cells[at, slot], m = m, self.cells[at, slot]
                at = int(self._other(np.array([at]), np.array([m]))[0])
            else:
                return False
        return True

    def remove(self, keys: np.ndarray) -> None:
        mark, one, two = self._places(keys)
        for m, a, b in zip(mark, one, two, strict=True):
            for at in (a, b):
                hit = np.flatnonzero(self.cells[at] == m)
                if len(hit):
                    self.cells[at, hit[0]] = 0
                    break

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        n = cls.sized(len(keys))
        while not (f := cls(n)).insert(keys):
            n *= 2
        return f


EDGE = " \t\r\x0b\x0c"
HELD = "k1 bigint, k2 bigint, n bigint"
STATE = "shard int, kind string, h1 bigint, h2 bigint, refs bigint, cells binary"
TAGGED = "shard int, kind string, h1 bigint, h2 bigint, refs bigint, cells binary, k1 bigint, k2 bigint, n int"


def _order_type(df: DataFrame, doc_id: str) -> str:
    """How ids are ordered: integers as such, all others by their text."""
    return "bigint" if isinstance(df.schema[position(df, doc_id)].dataType, T.IntegralType) else "string"


def documents(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """id (as it is ordered, the greatest bigint for a NULL one), row key k1, k2 and text, where there is one."""
    kind = _order_type(docs, doc_id)
    rank = F.col("id").cast(kind)
    if kind == "bigint":
        rank = F.coalesce(rank, F.lit(2**63 - 1))
    return pick(docs, id=doc_id, text=text).where("text IS NOT NULL").select(rank.alias("id"), *[k.alias(n) for k, n in zip(row_key(F.col("id"), F.col("text")), ("k1", "k2"), strict=True)], "text")


def line_rows(docs: DataFrame) -> DataFrame:
    """One row for each line of `documents` that isn't blank: the document's order, key and `times`
    (how often its lines count, 1 if not given), the line's number and 128-bit key."""
    line = F.btrim(F.col("line"), F.lit(EDGE))
    times = F.col("times") if "times" in docs.columns else F.lit(1)
    return (
        docs.select("id", "k1", "k2", times.cast("bigint").alias("times"), F.posexplode(F.split("text", "\n")).alias("n", "line"))
        .where(line != "")
        .select("id", "k1", "k2", "n", "times", F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(3), line).alias("h2"))
    )


def _codes(ids: np.ndarray) -> np.ndarray:
    """Numbers that order as the ids do; None comes last."""
    if ids.dtype != object:
        return ids
    none = np.array([x is None for x in ids], bool)
    out = np.full(len(ids), len(ids))
    out[~none] = np.unique(ids[~none], return_inverse=True)[1]
    return out


def _firsts(a: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by line key, then document order: that order, and where in it each key starts."""
    order = np.lexsort((a["n"], a["k2"], a["k1"], _codes(a["id"]), a["h2"], a["h1"]))
    start = np.ones(len(order), bool)
    if len(order) > 1:
        start[1:] = (np.diff(a["h1"][order]) != 0) | (np.diff(a["h2"][order]) != 0)
    return order, start


def _shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return (CuckooFilter.mix(h.view(np.uint64)) % np.uint64(shards)).astype(np.int32)


def _columns(t: pa.Table | pa.RecordBatch, *names: str) -> dict[str, np.ndarray]:
    return {c: t.column(c).to_numpy(zero_copy_only=False) if isinstance(t, pa.RecordBatch) else t.column(c).to_numpy() for c in names}


def combine(lines: DataFrame, shards: int) -> DataFrame:
    """Lines combined within a map task before any shuffle: one `line` row for each key with its count.

    The other rows of a key are repeats whatever the other tasks hold; they become `drop` rows,
    spread by document. So a line that half the corpus has sends one row a batch to its shard.
    """
    kind = dict(lines.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            a = _columns(b, "id", "k1", "k2", "n", "h1", "h2", "times")
            order, start = _firsts(a)
            first = order[start]
            refs = np.add.reduceat(a["times"][order], np.flatnonzero(start))
            drop = order[~start]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([_shard_of(a["h1"][first], shards), _shard_of(a["k1"][drop], shards)])),
                    pa.array(np.concatenate([np.zeros(len(first), bool), np.ones(len(drop), bool)])),
                    *[pa.array(np.concatenate([a[c][first], a[c][drop]])) for c in ("h1", "h2")],
                    pa.array(np.concatenate([refs, np.zeros(len(drop), np.int64)])),
                    pa.array(np.concatenate([a["id"][first], a["id"][drop]]), pa.int64() if kind == "bigint" else pa.string()),
                    *[pa.array(np.concatenate([a[c][first], a[c][drop]])) for c in ("k1", "k2", "n")],
                ],
                names=["shard", "gone", "h1", "h2", "refs", "id", "k1", "k2", "n"],
            )

    return lines.mapInArrow(lean(run, None), f"shard int, gone boolean, h1 bigint, h2 bigint, refs bigint, id {kind}, k1 bigint, k2 bigint, n int")


def _tagged(kind: str, shard: int, rows: int, **columns: np.ndarray) -> pa.Table:
    types = {"h1": pa.int64(), "h2": pa.int64(), "refs": pa.int64(), "cells": pa.binary(), "k1": pa.int64(), "k2": pa.int64(), "n": pa.int32()}
    return pa.table({"shard": pa.array(np.full(rows, shard, np.int32)), "kind": pa.array([kind] * rows, pa.string())} | {c: pa.array(columns[c], t) if c in columns else pa.nulls(rows, t) for c, t in types.items()})


def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each 128-bit key in the sorted table, or -1."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


PAIR = np.dtype([("h1", np.int64), ("h2", np.int64)])


def _pairs(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    out = np.empty(len(h1), PAIR)
    out["h1"], out["h2"] = h1, h2
    return out


def _known(state: pa.Table) -> tuple[np.ndarray, np.ndarray, CuckooFilter | None]:
    """A shard's sorted exact table, its counts and its filter."""
    kind = np.array(state.column("kind").to_pylist(), object)
    if not len(kind):
        return np.empty(0, PAIR), np.empty(0, np.int64), None
    refs = state.filter(pa.array(kind == "refs"))
    keys, counts = _pairs(*_columns(refs, "h1", "h2").values()), refs.column("refs").to_numpy()
    order = np.argsort(keys, order=("h1", "h2"))
    cells = [c for c in state.column("cells").to_pylist() if c is not None]
    f = CuckooFilter(len(cells[0]) // (2 * SLOTS), np.frombuffer(cells[0], np.uint16).copy()) if cells else None
    return keys[order], counts[order], f


def _state(shard: int, keys: np.ndarray, counts: np.ndarray, f: CuckooFilter) -> list[pa.Table]:
    return [_tagged("refs", shard, len(keys), h1=keys["h1"], h2=keys["h2"], refs=counts), _tagged("filter", shard, 1, cells=[f.cells.tobytes()])]


class LineIndex:
    """Which lines are there, and how often: for each shard of the line keys a cuckoo filter and
    the exact table of reference counts behind it, held as one DataFrame (`STATE`), and which
    documents are held (`held`: row key and how often).

    `insert` and `delete` give new indexes and leave the old one as it was. A document, which its id
    and text together name, may be inserted several times and then counts as often. After one is
    deleted each of its lines counts once less; a line that no document holds leaves filter and
    table, so that its next arrival is kept again: delete(insert(index, docs), docs) equals index.
    A document that isn't held, or not so often, is not deleted, so others' counts never suffer.
    Documents whose text is NULL aren't held; those without lines are, and change no count. Ids may
    be NULL and of any type. Empty tables change nothing. An index grows to as many shards as
    `per_shard` lines in each need, so a shard stays one task's memory.
    """

    def __init__(self, spark: SparkSession, shards: int = 64, state: DataFrame | None = None, held: DataFrame | None = None, per_shard: int = 250_000):
        self.spark, self.shards, self.per_shard = spark, shards, per_shard
        self.state = state if state is not None else spark.createDataFrame([], STATE)
        self.held = held if held is not None else spark.createDataFrame([], HELD)

    def _with(self, state: DataFrame, held: DataFrame | None, shards: int | None = None) -> LineIndex:
        out = LineIndex(self.spark, shards or self.shards, state, held, self.per_shard)
        if held is None:
            out.held = None
        return out

    def _apply(self, lines: DataFrame, merge: Callable) -> DataFrame:
        def shard(key: tuple, new: pa.Table, old: pa.Table) -> pa.Table:
            at = int(key[0].as_py())
            known, counts, f = _known(old)
            gone = new.column("gone").to_numpy()
            passed, fresh = new.filter(pa.array(gone)), new.filter(pa.array(~gone))
            a = _columns(fresh, "id", "k1", "k2", "n", "h1", "h2", "refs")
            order, start = _firsts(a)
            first, group = order[start], np.cumsum(start) - 1
            keys = _pairs(a["h1"][first], a["h2"][first])
            refs = np.bincount(group, a["refs"][order], len(first)).astype(np.int64) if len(order) else np.empty(0, np.int64)
            # The filter answers for most new lines; only the others are looked up exactly.
            place = np.full(len(keys), -1)
            maybe = f.contains(keys["h1"]) if f is not None and len(keys) else np.zeros(len(keys), bool)
            place[maybe] = _find(known, keys[maybe])
            dropped = np.concatenate([order[~start], first[place >= 0]]).astype(np.int64)
            parts = [_tagged("drop", at, len(dropped), **{c: a[c][dropped] for c in ("k1", "k2", "n")})]
            parts.append(_tagged("drop", at, passed.num_rows, **_columns(passed, "k1", "k2", "n")))
            return pa.concat_tables(parts + merge(at, known, counts, f, keys, refs, place))

        out = lines.groupBy("shard").cogroup(self.state.groupBy("shard")).applyInArrow(shard, TAGGED)
        return cut(out)

    def insert(self, docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: bool = True) -> tuple[LineIndex, DataFrame]:
        """The index with the documents' lines, and (k1, k2, n) of the lines that were there before
        or that an earlier document or line of the batch has. Without `keep` the documents aren't
        recorded, for an index from which none will be deleted."""
        own = documents(docs, text, doc_id)
        grown = self
        if keep:
            need = shards_for(docs, text, self.per_shard, -(-self.counts().count() // self.per_shard))
            grown = self.resharded(1 << (need - 1).bit_length()) if need > self.shards else self

        def merge(at, known, counts, f, keys, refs, place):  # noqa: ANN001, ANN202
            counts = counts.copy()
            np.add.at(counts, place[place >= 0], refs[place >= 0])
            add = keys[place < 0]
            every = np.concatenate([known, add])
            total = np.concatenate([counts, refs[place < 0]])
            if f is None or len(every) > 0.85 * SLOTS * f.buckets or not f.insert(add["h1"]):
                f = CuckooFilter.of(every["h1"])
            return _state(at, every, total, f)

        out = grown._apply(combine(line_rows(own), grown.shards), merge)
        held = None
        if keep and self.held is not None:
            held = cut(self.held.union(own.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"))).groupBy("k1", "k2").agg(F.sum("n").alias("n")))
        return grown._with(_of_state(out), held), out.where("kind = 'drop'").select("k1", "k2", "n")

    def delete(self, docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> LineIndex:
        """The index without these documents, of those that it holds."""
        if self.held is None:
            raise ValueError("this index doesn't record its documents: insert them with keep")
        asked = documents(docs, text, doc_id).groupBy("k1", "k2").agg(F.first("id").alias("id"), F.first("text").alias("text"), F.count(F.lit(1)).alias("asked"))
        own = asked.join(self.held, ["k1", "k2"]).withColumn("times", F.least("asked", "n")).drop("n")

        def merge(at, known, counts, f, keys, refs, place):  # noqa: ANN001, ANN202
            counts = counts.copy()
            np.subtract.at(counts, place[place >= 0], refs[place >= 0])
            dead = counts <= 0
            if f is not None:
                f.remove(known["h1"][dead])
            return _state(at, known[~dead], counts[~dead], f or CuckooFilter.of(known["h1"]))

        out = self._apply(combine(line_rows(own), self.shards), merge)
        gone = own.select("k1", "k2", F.col("times").alias("less"))
        held = cut(self.held.join(gone, ["k1", "k2"], "left").select("k1", "k2", (F.col("n") - F.coalesce("less", F.lit(0))).alias("n")).where("n > 0"))
        return self._with(_of_state(out), held)

    def resharded(self, shards: int) -> LineIndex:
        """The same index in so many shards: counts move, filters are built anew from them."""

        def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at = _shard_of(b.column("h1").to_numpy(), shards)
                yield pa.RecordBatch.from_arrays([pa.array(at), *[b.column(c) for c in ("h1", "h2", "refs")]], names=["shard", "h1", "h2", "refs"])

        def build(key: tuple, t: pa.Table) -> pa.Table:
            a = _columns(t, "h1", "h2", "refs")
            keys = _pairs(a["h1"], a["h2"])
            return pa.concat_tables(_state(int(key[0].as_py()), keys, a["refs"], CuckooFilter.of(keys["h1"])))

        out = self.counts().mapInArrow(lean(moved, None), "shard int, h1 bigint, h2 bigint, refs bigint").groupBy("shard").applyInArrow(build, TAGGED)
        return self._with(cut(_of_state(out)), self.held, shards)

    def save(self, folder: str) -> None:
        """Writes the index, for a later session's `load`; the folder must not hold one."""
        self.state.write.parquet(f"{folder}/state")
        if self.held is not None:
            self.held.write.parquet(f"{folder}/held")
        self.spark.createDataFrame([(self.shards, self.per_shard, self.held is not None)], "shards int, per_shard int, held boolean").write.parquet(f"{folder}/sizes")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> LineIndex:
        sizes = spark.read.parquet(f"{folder}/sizes").first()
        out = cls(spark, sizes["shards"], spark.read.schema(STATE).parquet(f"{folder}/state"), per_shard=sizes["per_shard"])
        out.held = spark.read.schema(HELD).parquet(f"{folder}/held") if sizes["held"] else None
        return out

    def counts(self) -> DataFrame:
        return self.state.where("kind = 'refs'").select("h1", "h2", "refs")

    def probe(self, docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
        """(k1, k2, n) of the lines that the index may hold, by the filters alone: never misses one.
        Of equal lines that meet in one task only the first is asked for."""

        def shard(key: tuple, new: pa.Table, old: pa.Table) -> pa.Table:
            f = _known(old)[2]
            a = _columns(new, "h1")
            hit = f.contains(a["h1"]) if f is not None and new.num_rows else np.zeros(new.num_rows, bool)
            return new.filter(pa.array(hit)).select(["k1", "k2", "n"])

        lines = combine(line_rows(documents(docs, text, doc_id)), self.shards).where("NOT gone")
        return lines.groupBy("shard").cogroup(self.state.groupBy("shard")).applyInArrow(shard, "k1 bigint, k2 bigint, n int")


def _of_state(tagged: DataFrame) -> DataFrame:
    return tagged.where("kind <> 'drop'").select(*[c.split()[0] for c in STATE.split(", ")])


def shards_for(docs: DataFrame, text: str, per_shard: int, more: int = 0) -> int:
    """Shards of about `per_shard` lines at most, 64 at least, besides `more`: a shard is one task's memory."""
    t = F.col("text")
    lines = pick(docs, text=text).agg(F.sum(F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1)).first()[0]
    return max(64, -(-(lines or 0) // per_shard) + more)


def in_order(docs: DataFrame, doc_id: str, batches: int) -> list[DataFrame]:
    """The table in about equal runs of ids, in their order, NULL last: one run if ids aren't integers."""
    if batches < 2 or _order_type(docs, doc_id) != "bigint":
        return [docs]
    at = F.col(f"__c{position(docs, doc_id)}")
    ids = numbered(docs).select(at.cast("double").alias("id"))
    bounds = sorted({int(x) for x in ids.approxQuantile("id", [k / batches for k in range(1, batches)], 0.02)})
    rows, parts = numbered(docs), []
    for low, high in zip([None, *bounds], [*bounds, None], strict=True):
        mine = F.lit(True) if low is None else (at >= low) | at.isNull() if high is None else at >= low
        parts.append(rows.where(mine if high is None else mine & (at < high)).toDF(*docs.columns))
    return parts


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", n_chars: str | None = None, per_shard: int = 250_000, index: LineIndex | None = None, batches: int = 2) -> DataFrame:
    """The table with repeated lines taken out of its texts; documents left without text go.

    Of equal lines (white space at the ends aside) the first stays: lines of `index` come before
    all, then documents go by `doc_id` (integers as such, others by their text), NULL last, ties by
    content; within one, lines go by place. Blank lines stay. A document whose text is NULL, empty
    or blank stays as it is. Of repeated equal rows only the first keeps its lines, so the others
    go. All columns stay, whatever their names; `n_chars`, if named, gets the new length. Empty
    input gives no rows. Documents are inserted in `batches` runs of ids; each meets the filters
    and counts of those before. The index has as many shards as lines of `per_shard` need.
    """
    names, i, t = docs.columns, position(docs, doc_id), position(docs, text)
    x = F.col(f"__c{t}")
    now, found = index or LineIndex(docs.sparkSession, shards_for(docs, text, per_shard)), []
    for part in in_order(docs, doc_id, batches):
        now, more = now.insert(part, text, doc_id, keep=False)
        found.append(more)
    repeats = reduce(DataFrame.union, found)
    gone = repeats.groupBy(F.col("k1").alias("__k1"), F.col("k2").alias("__k2")).agg(F.collect_list("n").alias("__gone"))
    again = F.row_number().over(Window.partitionBy("__k1", "__k2").orderBy("__k1"))
    rows = numbered(docs).select("*", *row_key(F.col(f"__c{i}"), x)).withColumns({"__rn": again, "__m": F.count(F.lit(1)).over(Window.partitionBy("__k1", "__k2"))})
    # Equal rows share a key: a line of theirs is gone from all of them only if it is from each.
    gone = gone.withColumnRenamed("__gone", "__all")
    left = F.expr(f"transform(array(split(__c{t}, '\n')), p -> array_join(transform(array_except(sequence(0, size(p) - 1), __gone), i -> p[i]), '\n'))[0]")
    every = F.expr("CASE WHEN __m = 1 THEN __all ELSE filter(array_distinct(__all), n -> size(filter(__all, x -> x = n)) >= __m) END")
    kept = rows.join(gone, ["__k1", "__k2"], "left").withColumn("__gone", every).withColumn("__new", F.when(F.col("__gone").isNull(), x).otherwise(left))
    bare = lambda c: F.btrim(c, F.lit(EDGE + "\n")) == ""
    blank = x.isNull() | bare(x)
    out = {t: F.col("__new")}
    if n_chars is not None:
        k = position(docs, n_chars)
        out[k] = F.length("__new").cast(docs.schema[k].dataType)
    kept = kept.where(blank | ((F.col("__rn") == 1) & ~bare(F.col("__new"))))
    return kept.select(*[out.get(k, F.col(f"__c{k}")).alias(f"__c{k}") for k in range(len(names))]).toDF(*names)
