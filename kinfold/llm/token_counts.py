"""Token counts at every prefix of a text, by dynamic programming over byte-level BPE."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
import pyspark.sql.functions as F

from kinfold.llm.common import pick, slices, lean

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHORT = frozenset(("'s", "'t", "'re", "'ve", "'m", "'ll", "'d"))


def load(ranks_path: str, pattern: str = PATTERN) -> tiktoken.Encoding:
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _wide() -> bool:
    raise OverflowError


class PrefixCounter:
    """Exact token counts of text[:1], text[:2], ... without encoding any prefix.

    Within one piece of the pre-tokeniser, the encoding of a prefix is that of a shorter prefix
    and one more token, and the one split whose last two tokens encode to themselves is it. So a
    table over the piece's bytes holds, for each prefix, its count and its last token. Across
    pieces counts add up. A piece's table is made once and kept.
    """

    def __init__(self, enc: tiktoken.Encoding, keep: int = 600_000):
        self.enc, self.ranks, self.keep = enc, enc._mergeable_ranks, keep
        self.longest = max(map(len, self.ranks))
        self.back = {v: k for k, v in self.ranks.items()}
        self.pairs: dict[int, bool] = {}
        self.tables: dict[str, bytes] = {}
        self.split = regex.compile(enc._pat_str).findall

    def _follows(self, a: int, b: int) -> bool:
        """Whether token b can come after token a (-1: at the start)."""
        k = (a << 20) + b
        ok = self.pairs.get(k)
        if ok is None:
            before = self.back[a] if a >= 0 else b""
            ok = self.pairs[k] = self.enc._encode_single_piece(before + self.back[b]) == ([a, b] if a >= 0 else [b])
        return ok

    def piece(self, text: str) -> list[int]:
        """Counts after each character of one piece."""
        if text in SHORT:  # the pre-tokeniser splits a part of these in another way
            return [len(self.enc.encode_ordinary(text[:i])) for i in range(1, len(text) + 1)]
        raw = text.encode("utf-8", "surrogatepass")
        n = len(raw)
        last, count = [-1] * (n + 1), [0] * (n + 1)
        rank, known, longest, start = self.ranks.get, self.pairs.get, self.longest, 0
        for i in range(1, n + 1):
            token = rank(raw[start:i])  # the last token of the shorter prefix, one byte longer
            if token is not None:
                ok = known((last[start] << 20) + token)
                if ok or ok is None and self._follows(last[start], token):
                    last[i], count[i] = token, count[start] + 1
                    continue
            for j in range(i - 1, max(0, i - longest) - 1, -1):
                token = rank(raw[j:i])
                if token is not None:
                    ok = known((last[j] << 20) + token)
                    if ok or ok is None and self._follows(last[j], token):
                        last[i], count[i], start = token, count[j] + 1, j
                        break
            else:  # a vocabulary with tokens that no merge reaches
                whole = self.enc._encode_single_piece(raw[:i])
                last[i], count[i], start = whole[-1], len(whole), i - len(self.back[whole[-1]])
        if n == len(text):
            return count[1:]
        ends = np.cumsum([len(c.encode("utf-8", "surrogatepass")) for c in text])
        return [count[e] for e in ends]

    def _steps(self, piece: str) -> bytes:
        """The piece's counts as differences of one byte each, or nothing where one doesn't fit."""
        counts = self.piece(piece)
        try:
            made = bytes([x - y & 255 for x, y in zip(counts, [0, *counts], strict=False) if -128 <= x - y < 128 or _wide()])
        except OverflowError:
            made = b""
        if len(piece) <= 32:
            if len(self.tables) >= self.keep:
                self.tables.clear()
            self.tables[piece] = made
        return made

    def counts(self, text: str) -> np.ndarray:
        """int32 array c with c[i] = tokens of text[: i + 1]."""
        pieces = self.split(text)
        get, made = self.tables.get, []
        odd = []
        for k, p in enumerate(pieces):
            s = get(p)
            if s is None:
                s = self._steps(p)
            if not s:
                odd.append(k)
                s = bytes(len(p))
            made.append(s)
        steps = np.frombuffer(b"".join(made), np.int8).astype(np.int32)
        at = None
        if odd:
            at = np.cumsum([0, *map(len, pieces)])
            for k in odd:
                steps[at[k] : at[k + 1]] = np.diff(np.array([0, *self.piece(pieces[k])]))
        out = np.cumsum(steps, dtype=np.int32)
        # White space before a word is one piece shorter than where the text ends after it.
        gaps = [k for k, p in enumerate(pieces) if k and p[0].isspace() and pieces[k - 1].isspace()]
        if gaps:
            at = np.cumsum([0, *map(len, pieces)]) if at is None else at
            for k in gaps:
                start = at[k - 1]
                out[at[k]] = (out[start - 1] if start else 0) + self.piece(pieces[k - 1] + pieces[k][0])[-1]
        return out


def pack(counts: np.ndarray) -> bytes:
    """Counts at every prefix as compressed differences."""
    steps = np.diff(counts, prepend=np.int32(0))
    small = len(steps) == 0 or (np.abs(steps) < 128).all()
    return (b"\1" if small else b"\4") + zlib.compress(steps.astype(np.int8 if small else np.int32).tobytes(), 1)


def unpack(table: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(table[1:]), np.int8 if table[:1] == b"\1" else np.int32), dtype=np.int32)


def tokens_at(table: bytes, chars: int) -> int:
    """Tokens of the text's first `chars` characters (of all, if it is shorter)."""
    c = unpack(table)
    return int(c[min(chars, len(c)) - 1]) if chars > 0 and len(c) else 0


def fits(counts: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix that takes at most `budget` tokens. Counts may fall as a
    text goes on (a merge), so the last fitting place counts, not the first that doesn't fit."""
    hit = np.flatnonzero(counts <= budget)
    return int(hit[-1]) + 1 if len(hit) else 0


def token_counts(docs: DataFrame, ranks_path: str, text: str = "text", doc_id: str = "doc_id", budgets: Sequence[int] = (128, 512, 2048), pattern: str = PATTERN) -> DataFrame:
    """doc_id, n_tokens, the longest prefix in characters for each budget (`fit_<budget>`) and
    `prefix_counts`, the packed table of the exact count at every prefix.

    One row for each row of the table. NULL text gives NULL in all columns but doc_id; '' has 0
    tokens and an empty table. doc_id may be NULL, repeated and of any type. Other columns don't
    matter. `ranks_path` must be readable where the tasks run.
    """
    d = pick(docs, doc_id=doc_id, text=text)
    kind = d.schema["doc_id"].dataType
    budgets = tuple(budgets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PrefixCounter(load(ranks_path, pattern))
        for b in batches:
            texts = b.column("text").to_pylist()
            for i, j in slices([len(t or "") for t in texts], 8_000_000):
                n, fit, tables = [], [[] for _ in budgets], []
                for t in texts[i:j]:
                    c = None if t is None else counter.counts(t)
                    n.append(None if c is None else int(c[-1]) if len(c) else 0)
                    tables.append(None if c is None else pack(c))
                    for k, most in enumerate(budgets):
                        fit[k].append(None if c is None else fits(c, most))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(i, j - i), pa.array(n, pa.int64()), *[pa.array(f, pa.int64()) for f in fit], pa.array(tables, pa.binary())],
                    names=["doc_id", "n_tokens", *[f"fit_{m}" for m in budgets], "prefix_counts"],
                )

    schema = f"doc_id {kind.simpleString()}, n_tokens bigint, {''.join(f'fit_{m} bigint, ' for m in budgets)}prefix_counts binary"
    return d.mapInArrow(lean(run), schema)


def truncated(docs: DataFrame, counts: DataFrame, budget: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and the text cut to `budget` tokens, from stored tables: nothing is encoded again.
    Rows meet on doc_id, so ids should be distinct; a NULL id has no table and isn't returned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cut = [None if c is None or t is None else t[: fits(unpack(c), budget)] for t, c in zip(b.column("text").to_pylist(), b.column("prefix_counts").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(cut, pa.string())], names=["doc_id", "text"])

    d = pick(docs, doc_id=doc_id, text=text)
    both = d.join(counts.select(F.col("doc_id"), "prefix_counts"), "doc_id")
    return both.mapInArrow(lean(run), f"doc_id {d.schema['doc_id'].dataType.simpleString()}, text string")
