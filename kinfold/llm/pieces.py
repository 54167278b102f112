"""SentencePiece encoding and decoding with Gumbel top-k sampling over the segmentation lattice."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame

from kinfold.llm.common import LETTERS, free_name, pick, slices, lean

BAR = "▁"
TAKEN = "\udfff"  # stands for a BAR of the text itself, so that it isn't taken for a space; no text has it
END = -1
INNER, START, OTHER = 0, 1, 2
NEAR = 48
SCALE = 4.0
PART = 8_000  # units whose lattices are built together: their arrays stay in the cache
GOLD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(base: np.ndarray, sample: int, step: int, kind: int) -> np.ndarray:
    """Numbers in (0, 1) that depend on nothing but the row's seed and the place in the search."""
    salt = np.uint64(((sample * 4096 + step) * 8 + kind + 1) * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF)
    return ((_mix(base + salt) >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


class Lattice:
    """All segmentations of texts' units, with their exact probabilities.

    A unit is a run of word starts and what follows it up to the next; characters that no longer
    piece has stand alone. No piece crosses units, so a text's lattice is the product of theirs.
    A node is a place in a unit: its edges are the pieces that start there, and its weight, the
    sum over all segmentations of the unit's rest, gives each edge its probability.
    A piece's weight is 1 / (rank + 2) to the power `theta`, the rank being its merge's place; a
    character that is no piece is spelt in bytes, as one edge.
    """

    def __init__(self, model_path: str, theta: float = 1.0):
        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.sp = sp
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.piece = [sp.id_to_piece(i) for i in range(n)]
        self.id = {self.piece[i]: i for i in plain}
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        first = min(plain)
        self.log = np.zeros(n)
        for i in plain:
            self.log[i] = -theta * np.log(i - first + 2.0)
        self.rare = -theta * np.log(n + 2.0)
        self.text = [p.replace(BAR, " ").encode() for p in self.piece]
        for b in range(256):
            self.text[self.byte[b]] = bytes([b])
        self.bytes = np.array([len(b) for b in self.text])
        self.first = np.cumsum(self.bytes) - self.bytes
        self.spelling = np.frombuffer(b"".join(self.text), np.uint8)
        self.longest = max(len(p) for p in self.id)
        inner = {c for p in self.id if len(p) > 1 for c in p if c != BAR}
        self.units = re.compile(f"{BAR}*[{''.join(re.escape(c) for c in sorted(inner))}]+|{BAR}+|.", re.DOTALL).findall
        self.kind = np.full(0x110000, OTHER, np.uint8)
        self.kind[[ord(c) for c in inner]] = INNER
        self.kind[ord(BAR)] = START
        # A trie of the longer pieces, as one table of children by (node, letter); single letters apart.
        self.alone = np.full(0x110000, -1, np.int32)
        letters: dict[str, int] = {}
        rows: list[dict[int, int]] = [{}]
        ends = [-1]
        for p, i in self.id.items():
            if len(p) == 1:
                self.alone[ord(p)] = i
                continue
            at = 0
            for c in p:
                k = letters.setdefault(c, len(letters) + 1)
                if k not in rows[at]:
                    rows[at][k] = len(rows)
                    rows.append({})
                    ends.append(-1)
                at = rows[at][k]
            ends[at] = i
        self.letter = np.zeros(0x110000, np.int32)
        for c, k in letters.items():
            self.letter[ord(c)] = k
        self.ends, self.width = np.array(ends, np.int32), len(letters) + 1
        self.child = np.zeros(len(rows) * self.width, np.uint16 if len(rows) < 2**16 else np.int32)
        for r, row in enumerate(rows):
            for k, x in row.items():
                self.child[r * self.width + k] = x

    def build(self, units: list[str]) -> Edges:
        """The lattice of distinct units."""
        return self.built(np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32), np.fromiter(map(len, units), np.int64, len(units)))

    def cut(self, texts: list[str], salt: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What `units` finds in all texts at once: all letters, where units begin, the unit's hash and
        the row it is in."""
        raw = [self.normalized(t).encode("utf-32-le", "surrogatepass") for t in texts]
        whole = b"".join(raw) + b"\0" * 8
        codes = np.frombuffer(whole, np.uint32)
        n = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        kind = self.kind[codes]
        before = np.append(OTHER, kind[:-1])
        new = (kind == OTHER) | (before == OTHER) | ((kind == START) & (before != START))
        ends = np.cumsum(n)
        new[ends] = True  # also the padding after the last text
        start = np.flatnonzero(new[: ends[-1]]) if len(n) else np.empty(0, np.int64)
        size = np.diff(start, append=ends[-1] if len(n) else 0)
        two = np.ndarray((len(codes) - 1,), np.uint64, whole, strides=(4,))
        low = np.uint64(0xFFFFFFFF)
        h = _mix(np.where(size > 1, two[start], two[start] & low) + GOLD + np.uint64(salt))
        left, step = np.flatnonzero(size > 2), 2
        while len(left):
            x = two[start[left] + step]
            h[left] = _mix(h[left] * GOLD + np.where(size[left] - step > 1, x, x & low) + np.uint64(1))
            step += 2
            left = left[size[left] > step]
        return codes, start, h, np.searchsorted(ends, start, side="right")

    def built(self, codes: np.ndarray, n: np.ndarray) -> Edges:
        """The lattice of units given as their letters, end to end, and their lengths."""
        codes = codes.astype(np.int64)
        letter = self.letter[codes]
        total = len(codes)
        first = np.cumsum(n) - n
        end = np.repeat(first + n, n)
        alone = self.alone[codes]
        ones = np.flatnonzero(alone >= 0)
        src, dst, pid = [ones], [ones + 1], [alone[ones]]
        pos = np.flatnonzero(letter)
        at = self.child[letter[pos]]
        pos, at = pos[at > 0], at[at > 0]
        for depth in range(1, self.longest):
            ok = pos + depth < end[pos]
            pos, at = pos[ok], at[ok]
            at = self.child[at.astype(np.int64) * self.width + letter[pos + depth]]
            live = at > 0
            pos, at = pos[live], at[live]
            if not len(pos):
                break
            i = self.ends[at]
            hit = i >= 0
            src.append(pos[hit])
            dst.append(pos[hit] + depth + 1)
            pid.append(i[hit])
        one = alone < 0
        odd = np.flatnonzero(one)
        low = codes[odd] < 128
        src.append(odd)
        dst.append(odd + 1)
        pid.append(np.where(low, np.array(self.byte)[np.minimum(codes[odd], 127)], -codes[odd] - 1))
        # Edges by node without a sort: each depth's go to their nodes' next free places.
        each = np.zeros(total + 1, np.int64)
        for x in src:
            each[x + 1] += 1
        start = np.cumsum(each)
        s, d, i = (np.empty(start[-1], np.int32) for _ in range(3))
        free = start[:-1].copy()
        for x, y, z in zip(src, dst, pid, strict=True):
            at = free[x]
            s[at], d[at], i[at] = x, y, z
            free[x] += 1
        w = np.where(i >= 0, self.log[np.maximum(i, 0)], 0.0)
        rare = one[s] if total else np.empty(0, bool)
        c = codes[s[rare]]
        w[rare] = self.rare * (1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF))
        d = np.where(d == end[s], END, d)
        # Backward sums, all places that are as far from their unit's end at once. Near an end they
        # are plain products, scaled by the letter so that they stay about 1; beyond, logarithms.
        far = end - np.arange(total)
        longest = int(n.max(initial=0))
        of = far[s].astype(np.uint16 if longest < 2**16 else np.int64)  # 16 bits are sorted by radix
        by_far = np.argsort(of, kind="stable")
        cuts = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=longest + 1)[1:])])
        odds = np.exp(w + SCALE * (of - np.where(d == END, 0, far[d]))) if total else w
        weight = np.zeros(total + 1)
        weight[END] = 1.0
        near = min(longest, NEAR)
        for r in range(near):
            e = by_far[cuts[r] : cuts[r + 1]]
            if len(e):
                each = odds[e] * weight[d[e]]
                odds[e] = each
                heads = np.flatnonzero(np.diff(s[e], prepend=-1))
                weight[s[e[heads]]] = np.add.reduceat(each, heads)
        e = by_far[: cuts[near]]
        odds[e] /= weight[s[e]]
        if longest > near:
            weight = np.log(np.where(weight > 0, weight, 1.0))
            weight[:-1] -= SCALE * far
            weight[END] = 0.0
            score = w + 0.0
            for r in range(near, longest):
                e = by_far[cuts[r] : cuts[r + 1]]
                if not len(e):
                    continue
                score[e] = w[e] + weight[d[e]]
                heads = np.flatnonzero(np.diff(s[e], prepend=-1))
                top = np.maximum.reduceat(score[e], heads)
                count = np.diff(np.append(heads, len(e)))
                weight[s[e[heads]]] = top + np.log(np.add.reduceat(np.exp(score[e] - np.repeat(top, count)), heads))
            e = by_far[cuts[near] :]
            odds[e] = np.exp(score[e] - weight[s[e]])
        odds = np.minimum(odds, 1.0)
        run = np.concatenate([[0.0], np.cumsum(odds)])
        cum = run[1:] - run[start[s]] + s
        last = start[1:][start[1:] > start[:-1]] - 1
        cum[last] = s[last] + 1
        single = np.zeros(len(s), bool)
        single[last] = np.diff(last, prepend=-1) == 1
        return Edges(start, i, d, cum, odds, single, first)

    def normalized(self, text: str) -> str:
        """What the model segments: a word start in front, and one for each space."""
        return BAR + text.replace(BAR, TAKEN).replace(" ", BAR) if text else ""

    def spell(self, ids: np.ndarray) -> np.ndarray:
        """Piece ids, with characters that no piece has as their bytes."""
        if not (ids < 0).any():
            return ids.astype(np.int32)
        out: list[int] = []
        for i in ids.tolist():
            c = chr(-i - 1) if i < 0 else ""
            out += [self.byte[b] for b in (BAR if c == TAKEN else c).encode("utf-8", "surrogatepass")] if c else [i]
        return np.array(out, np.int32)

    def exact(self, samples: list[np.ndarray], texts: list[str]) -> np.ndarray:
        """Whether each sample decodes to its text, by one comparison of all their bytes."""
        want = [(" " + t if t else "").encode("utf-8", "surrogatepass") for t in texts]
        ids = np.concatenate(samples) if samples else np.empty(0, np.int32)
        n = self.bytes[ids]
        each = np.append(0, np.cumsum(n))
        bounds = each[np.append(0, np.cumsum([len(x) for x in samples]))].astype(np.int64)
        sizes = np.array([len(w) for w in want], np.int64)
        ok = np.diff(bounds) == sizes
        if not ok.all():
            return np.array([self.decode(x) == t for x, t in zip(samples, texts, strict=True)], bool)
        kind = np.int32 if each[-1] < 2**31 else np.int64
        at = np.arange(each[-1], dtype=kind) + np.repeat((self.first[ids] - each[:-1]).astype(kind), n)
        wrong = np.flatnonzero(self.spelling[at] != np.frombuffer(b"".join(want), np.uint8))
        out = np.ones(len(texts), bool)
        out[np.unique(np.searchsorted(bounds, wrong, side="right") - 1)] = False
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of a segmentation: the exact inverse of `spell` over `normalized`."""
        return b"".join(map(self.text.__getitem__, ids.tolist())).decode("utf-8", "replace")[1:]


class Edges(NamedTuple):
    """Edges of all nodes, by node: where each node's begin, piece, next node, cumulated odds plus
    node, odds, whether it is its node's only one; the node of each unit. A unit's last edge leads to END."""

    start: np.ndarray
    piece: np.ndarray
    after: np.ndarray
    cum: np.ndarray
    odds: np.ndarray
    single: np.ndarray
    unit: np.ndarray

    @staticmethod
    def joined(parts: list[Edges]) -> Edges:
        """All lattices as one."""
        if len(parts) == 1:
            return parts[0]
        nodes = np.cumsum([0, *[len(p.start) - 1 for p in parts]])
        edges = np.cumsum([0, *[len(p.piece) for p in parts]])
        return Edges(
            np.concatenate([parts[0].start[:1], *[p.start[1:] + x for p, x in zip(parts, edges, strict=False)]]),
            np.concatenate([p.piece for p in parts]),
            np.concatenate([np.where(p.after == END, END, p.after + np.int32(x)) for p, x in zip(parts, nodes, strict=False)]),
            np.concatenate([p.cum + x for p, x in zip(parts, nodes, strict=False)]),
            np.concatenate([p.odds for p in parts]),
            np.concatenate([p.single for p in parts]),
            np.concatenate([p.unit + x for p, x in zip(parts, nodes, strict=False)]),
        )


class Paths(NamedTuple):
    """Steps of one path for each row, by row: row, unit, edge, log probability before the step,
    key of the children not taken."""

    row: np.ndarray
    unit: np.ndarray
    edge: np.ndarray
    before: np.ndarray
    rest: np.ndarray


class Sampler:
    """The k segmentations of each text with the greatest perturbed log-probabilities, by A*.

    A search node is a prefix of the segmentation and stands for all that start so. Its log
    probability phi is exact, and its key is the greatest of the Gumbel-perturbed phi below it:
    Gumbel(phi) for the root and, below a node, Gumbels given that their greatest is its key. So
    keys never rise on the way down and the first k leaves taken are k draws without replacement.
    A taken node is followed along its greatest child in one go; at each step all other children
    stay one node of the queue, and it splits only when its own turn comes. All rows advance
    together: each of the k turns is a few array operations.
    """

    def __init__(self, edges: Edges):
        self.e = edges
        self.log = np.log(np.maximum(edges.odds, 1e-300))
        with np.errstate(divide="ignore"):
            self.rest = np.where(edges.single, -np.inf, np.log1p(-np.minimum(edges.odds, 1 - 1e-16)))

    def walk(self, nodes: np.ndarray, at: np.ndarray, seed: np.ndarray, sample: int) -> tuple[np.ndarray, np.ndarray]:
        """Draws a segmentation of each unit: (unit's index, edge) of each step, unit by unit."""
        e = self.e
        here, live, which, edges = nodes.copy(), np.arange(len(nodes)), [], []
        base = _mix(seed + GOLD * at.astype(np.uint64))
        step = 0
        while len(live):
            u = _uniform(base, sample, step, 0)
            edge, goal = e.start[here], here + u
            on = np.flatnonzero(e.cum[edge] <= goal)
            while len(on):
                edge[on] += 1
                on = on[e.cum[edge[on]] <= goal[on]]
            which.append(live)
            edges.append(edge)
            here = e.after[edge]
            on = here != END
            here, live, base = here[on], live[on], base[on]
            step += 1
        if not which:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        each = np.zeros(len(nodes) + 1, np.int64)
        for x in which:
            each[x + 1] += 1
        free = np.cumsum(each)
        w, x = np.empty(free[-1], np.int64), np.empty(free[-1], np.int64)
        for units, steps in zip(which, edges, strict=True):
            to = free[units]
            w[to], x[to] = units, steps
            free[units] += 1
        return w, x

    def keys(self, before: np.ndarray, edge: np.ndarray, top: np.ndarray, seed: np.ndarray, sample: int, step: np.ndarray) -> np.ndarray:
        """Keys of the other children at each step: a Gumbel of their joint phi, cut off at `top`."""
        loc = before + self.rest[edge]
        u = _uniform(_mix(seed + GOLD * step.astype(np.uint64)), sample, 0, 2)
        with np.errstate(over="ignore", invalid="ignore"):
            key = loc - np.log(np.exp(loc - top) - np.log(u))
        return np.where(np.isneginf(loc), -np.inf, key)

    @staticmethod
    def sums(x: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sums before each element within its row, where rows begin, and each row's whole."""
        ends = np.searchsorted(row, np.arange(rows + 1))
        run = np.concatenate([[0.0], np.cumsum(x)])
        return run[:-1] - run[ends[:-1]][row], ends, run[ends[1:]] - run[ends[:-1]]

    def sample(self, nodes: np.ndarray, row: np.ndarray, seeds: np.ndarray, k: int) -> list[list[tuple[np.ndarray | None, float, float]]]:
        """For each row its (pieces, log probability, key), greatest key first; fewer where the text
        has fewer segmentations; then (None, -inf, the next key), the key being -inf if none is left."""
        e, rows = self.e, len(seeds)
        bounds = np.searchsorted(row, np.arange(rows + 1))
        at = np.arange(len(nodes)) - bounds[row]
        unit, edge = self.walk(nodes, at, seeds[row], 0)
        of = row[unit]
        before, ends, whole = self.sums(self.log[edge], of, rows)
        root = -np.log(-np.log(_uniform(_mix(seeds), 0, 0, 1)))
        rest = self.keys(before, edge, root[of], seeds[of], 0, np.arange(len(of)) - ends[of])
        paths = [Paths(of, unit, edge, before, rest)]
        at_path = [ends]
        out = [[(e.piece[edge[ends[r] : ends[r + 1]]], float(whole[r]), float(root[r]))] for r in range(rows)]
        used: dict[tuple[int, int], list[int]] = {}
        for turn in range(1, k + 1):
            best, where, step = np.full(rows, -np.inf), np.full(rows, -1), np.zeros(rows, np.int64)
            for j, (p, x) in enumerate(zip(paths, at_path, strict=True)):
                there = np.flatnonzero(x[1:] > x[:-1])
                if not len(there):
                    continue
                most = np.full(rows, -np.inf)
                most[there] = np.maximum.reduceat(p.rest, x[there])
                for r in np.flatnonzero(most > best):
                    best[r], where[r] = most[r], j
            grown = np.flatnonzero(best > -np.inf)
            if turn == k:
                for r in range(rows):
                    if out[r][-1][0] is not None:
                        out[r].append((None, -np.inf, float(best[r])))
                break
            for r in np.flatnonzero(best == -np.inf):
                if out[r][-1][0] is not None:
                    out[r].append((None, -np.inf, -np.inf))
            heads, tails = [], []
            for r in grown:
                j = int(where[r])
                p, x = paths[j], at_path[j]
                i = int(x[r] + p.rest[x[r] : x[r + 1]].argmax())
                step[r] = i - x[r]
                taken = used.setdefault((j, i), [int(p.edge[i])])
                # The greatest child among those not taken, by their probabilities.
                node = int(np.searchsorted(e.start, p.edge[i], side="right")) - 1
                lo, hi = int(e.start[node]), int(e.start[node + 1])
                odds = e.odds[lo:hi].copy()
                odds[[t - lo for t in taken]] = 0
                share = np.cumsum(odds)
                u, w = (float(_uniform(_mix(seeds[r : r + 1] + GOLD * step[r : r + 1].astype(np.uint64)), turn, c, 3)[0]) for c in (0, 1))
                new = lo + min(int(np.searchsorted(share, u * share[-1], side="right")), hi - lo - 1)
                taken.append(new)
                left = float(share[-1] - odds[new - lo])
                if len(taken) < hi - lo and left > 0:
                    loc = p.before[i] + np.log(left)
                    p.rest[i] = loc - np.log(np.exp(loc - best[r]) - np.log(w))
                else:
                    p.rest[i] = -np.inf
                unit = int(p.unit[i])
                heads.append((r, j, int(x[r]), i, new, unit, float(p.before[i])))
                tails.append(np.concatenate([[e.after[new]] if e.after[new] != END else [], nodes[unit + 1 : bounds[r + 1]]]).astype(np.int64))
            # From each new child on: its unit's rest, then the later units.
            size = np.array([len(t) for t in tails], np.int64)
            own = np.repeat(np.arange(len(tails)), size)
            low = np.array([h[5] + (e.after[h[4]] == END) for h in heads], np.int64)
            places = (np.arange(len(own)) - (np.cumsum(size) - size)[own]) + (low[own] if len(own) else 0)
            grown_seeds = seeds[grown]
            which, edge = self.walk(np.concatenate(tails) if tails else np.empty(0, np.int64), places - (bounds[grown[own]] if len(own) else 0), grown_seeds[own], turn)
            of = own[which]
            phi = np.array([h[6] + self.log[h[4]] for h in heads])
            before, ends, whole = self.sums(self.log[edge], of, len(heads))
            before = before + (phi[of] if len(of) else 0)
            depth = np.arange(len(of)) - ends[of] + (step[grown][of] + 1 if len(of) else 0)
            rest = self.keys(before, edge, best[grown][of], grown_seeds[of], turn, depth)
            parts, starts = [[] for _ in range(5)], np.zeros(rows + 1, np.int64)
            for m, (r, j, x, i, new, unit, b) in enumerate(heads):
                p, s = paths[j], slice(int(ends[m]), int(ends[m + 1]))
                full = np.concatenate([p.edge[x:i], [new], edge[s]])
                parts[0].append(np.full(len(full), r))
                parts[1].append(np.concatenate([p.unit[x:i], [unit], places[which[s]]]))
                parts[2].append(full)
                parts[3].append(np.concatenate([p.before[x:i], [b], before[s]]))
                parts[4].append(np.concatenate([np.full(i - x + 1, -np.inf), rest[s]]))
                starts[r + 1] = len(full)
                out[r].append((e.piece[full], float(phi[m] + whole[m]), float(best[r])))
            if parts[0]:
                paths.append(Paths(*[np.concatenate(q) for q in parts]))
                at_path.append(np.cumsum(starts))
        return out


def seed_of(key: object) -> int:
    return xxhash.xxh3_64_intdigest(repr(key))


def segment(docs: DataFrame, model_path: str, text: str = "text", doc_id: str = "doc_id", k: int = 2, theta: float = 1.0, seed: int = 0, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, the columns to `keep`, `n_pieces` of the first sample, `exact` (each sample decodes to
    the text) and `samples`: k distinct segmentations drawn without replacement, best first, each
    with its piece ids as little-endian int32 bytes, log probability, perturbed key and inclusion
    score. `decoded` turns them back to texts.

    The inclusion score is 1 - exp(-exp(log probability - kappa)), the chance to be among the k
    given the k+1st key kappa; 1 where the text has no more than k segmentations. Draws depend on
    doc_id, the text and `seed` alone, so reruns and repartitions give the same; repeated equal
    rows get equal samples. NULL text gives NULL columns; '' has no samples. Whole texts are
    segmented, whatever their length, and any text decodes to itself: a U+2581 in it is spelt in
    bytes, so that it isn't taken for a space. Units are told apart by a hash; should two of a batch
    share one, the texts that then don't decode are segmented again by another. doc_id may be NULL
    and of any type; an empty table has no rows. A new column whose name a kept one has is numbered.
    `model_path` must be readable where the tasks run.
    """
    d = pick(docs, doc_id=doc_id, text=text, **{f"__keep{n}": c for n, c in enumerate(keep)})
    sampled = pa.list_(pa.struct([("ids", pa.binary()), ("log_prob", pa.float64()), ("key", pa.float64()), ("inclusion", pa.float64())]))
    extra = [f"__keep{n}" for n in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(model_path, theta)
        for b in batches:
            keys, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            for i, j in slices([len(t or "") for t in texts], LETTERS):
                own = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), *[own.column(c) for c in extra], *part(lattice, keys[i:j], texts[i:j])], names=["doc_id", *extra, "n_pieces", "exact", "samples"])

    def part(lattice: Lattice, keys: list, texts: list) -> list[pa.Array]:
        seeds = [seed_of((seed, x, t)) for x, t in zip(keys, texts, strict=True)]
        found = sample_texts(lattice, texts, seeds, k)
        samples, exact, n = [], [], []
        drawn = [(lattice.spell(pieces), t) for t, got in zip(texts, found, strict=True) if t for pieces, _, _ in got[:-1]]
        checked = iter(zip([x for x, _ in drawn], lattice.exact([x for x, _ in drawn], [t for _, t in drawn]).tolist(), strict=True))
        for t, own, got in zip(texts, seeds, found, strict=True):
            if not t:
                samples.append(None if t is None else [])
                exact.append(None if t is None else True)
                n.append(None if t is None else 0)
                continue
            spelt = [next(checked) for _ in got[:-1]]
            if not all(same for _, same in spelt):
                got = sample_texts(lattice, [t], [own], k, salt=1)[0]
                spelt = [(x, lattice.decode(x) == t) for x in (lattice.spell(pieces) for pieces, _, _ in got[:-1])]
            kappa = got[-1][2]
            samples.append([{"ids": x.tobytes(), "log_prob": logp, "key": key, "inclusion": 1.0 if kappa == -np.inf else float(-np.expm1(-np.exp(min(logp - kappa, 50.0))))} for (x, _), (_, logp, key) in zip(spelt, got[:-1], strict=True)])
            exact.append(all(same for _, same in spelt))
            n.append(len(spelt[0][0]))
        return [pa.array(n, pa.int64()), pa.array(exact, pa.bool_()), pa.array(samples, sampled)]

    types = "".join(f"{c} {d.schema[c].dataType.simpleString()}, " for c in ["doc_id", *extra])
    out = d.mapInArrow(lean(run), f"{types}n_pieces bigint, exact boolean, samples array<struct<ids: binary, log_prob: double, key: double, inclusion: double>>")
    names = ["doc_id", *keep]
    for new in ("n_pieces", "exact", "samples"):
        names.append(free_name(names, new))
    return out.toDF(*names)


def decoded(segments: DataFrame, model_path: str, samples: str = "samples", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and the `texts` that a row's samples decode to, one for each: the inverse of `segment`.

    One row for each row. NULL samples give NULL, an empty list (of the empty text) an empty list.
    Any int32 ids of the model's pieces decode; bytes that make no character become U+FFFD.
    """
    d = pick(segments, doc_id=doc_id, samples=samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(model_path)
        for b in batches:
            cells = [None if x is None else [lattice.decode(np.frombuffer(y["ids"], np.int32)) for y in x] for x in b.column("samples").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(cells, pa.list_(pa.string()))], names=["doc_id", "texts"])

    return d.mapInArrow(lean(run, 200), f"doc_id {d.schema['doc_id'].dataType.simpleString()}, texts array<string>")


def sample_texts(lattice: Lattice, texts: list[str | None], seeds: list[int], k: int, salt: int = 0) -> list[list[tuple[np.ndarray | None, float, float]]]:
    """`Sampler.sample` over texts; their distinct units are built once for all."""
    codes, start, hashes, row = lattice.cut([t or "" for t in texts], salt)
    _, first, number = np.unique(hashes, return_index=True, return_inverse=True)
    size = np.diff(start, append=len(codes) - 2)[first]  # the letters end before their padding
    parts = []
    for i in range(0, max(1, len(first)), PART):
        n = size[i : i + PART]
        at = np.arange(n.sum()) + np.repeat(start[first[i : i + PART]] - (np.cumsum(n) - n), n)
        parts.append(lattice.built(codes[at], n))
    edges = Edges.joined(parts)
    return Sampler(edges).sample(edges.unit[number] if len(number) else number, row, np.array(seeds, np.uint64), k)
