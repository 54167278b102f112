"""Licence scan: sparse TF-IDF cosine to templates, then inheritance from the nearest directory."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
import pyspark.sql.functions as F

from kinfold.llm.common import BUCKETS, Terms, bucket_frequencies, cut, idf, pick, slices, words, lean

TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", 'This software is licensed under Apache License 2.0, to be used in compliance with its terms'],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."],
    "GPL-2.0": ["Licensed under the GNU General Public License, version 2."],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["Released into the public domain under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "Proprietary": ["All rights reserved.", "Copyright. All rights reserved. Unauthorized copying is prohibited."],
}
FILE_NAME = r"(?i)(^|/)(licen[cs]es?|copying|copyright|unlicense|notice)([._-][^/]*)?$"


class Templates:
    """Templates as sparse unit TF-IDF vectors over the corpus's document frequencies."""

    def __init__(self, texts: dict[str, list[str]], df: np.ndarray, n: int):
        self.names, rows = [], []
        for name, ts in texts.items():
            for t in ts:
                if words(t):
                    self.names.append(name)
                    rows.append(Counter(words(t)))
        self.terms = sorted({w for r in rows for w in r})
        weights = idf(df, n)
        self.weights = np.concatenate([weights, weights[Terms(BUCKETS, self.terms).hash.astype(np.int64) & (BUCKETS - 1)]])
        place = {t: i for i, t in enumerate(self.terms)}
        self.rows = np.zeros((len(rows), len(self.terms)))
        for i, r in enumerate(rows):
            for w, c in r.items():
                self.rows[i, place[w]] = c * self.weights[BUCKETS + place[w]]
        self.rows /= np.linalg.norm(self.rows, axis=1, keepdims=True)
        self.size = np.array([sum(r.values()) for r in rows], np.int64)
        # What one occurrence of a word adds to each template's inner product with a text.
        self.gain = self.rows * self.weights[BUCKETS:]

    def cosines(self, at: np.ndarray, own: np.ndarray, n: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Units (own: each word's unit, of n) that may reach `least`, and their exact cosines with all
        templates. The templates' words have a share of a unit's squared norm that is no less than
        its squared cosine with any of them, so units under least squared are passed over."""
        key = own * np.int64(len(self.weights)) + at
        key.sort()
        first = np.flatnonzero(np.diff(key, prepend=-1))
        c = np.diff(np.append(first, len(key)))
        unit, term = key[first] // len(self.weights), key[first] % len(self.weights)
        w = c * self.weights[term]
        known = term >= BUCKETS
        norm = np.bincount(unit, w * w, n)
        may = np.bincount(unit[known], w[known] ** 2, n) >= least**2 * norm * (1 - 1e-9)
        hit = np.flatnonzero(may & (norm > 0))
        place = np.full(n, -1)
        place[hit] = np.arange(len(hit))
        on = known & (place[unit] >= 0)
        unit, term, w = place[unit[on]], term[on] - BUCKETS, w[on]
        dot = np.zeros((len(hit), len(self.rows)))
        heads = np.flatnonzero(np.diff(unit, prepend=-1))
        for i in range(0, len(heads), 4096):
            some = heads[i : i + 4096]
            end = heads[i + 4096] if i + 4096 < len(heads) else len(unit)
            s = slice(some[0], end)
            dot[unit[some]] = np.add.reduceat(w[s, None] * self.rows[:, term[s]].T, some - some[0])
        return hit, dot / np.sqrt(norm[hit])[:, None]

    def best(self, at: np.ndarray, n: np.ndarray, least: float) -> dict[int, tuple[float, int]]:
        """For each text (words end to end, counts) with a cosine of `least` or more: it and the
        template, the first of equal ones."""
        if not len(at):
            return {}
        hit, cos = self.cosines(at, np.repeat(np.arange(len(n)), n), len(n), least)
        top = np.round(cos, 12).argmax(axis=1) if len(hit) else np.empty(0, np.int64)
        return {i: (float(cos[k, t]), int(t)) for k, (i, t) in enumerate(zip(hit.tolist(), top.tolist(), strict=True)) if cos[k, t] >= least}

    def windows(self, at: np.ndarray, n: np.ndarray, least: float) -> Iterator[tuple[int, float, int, int, int]]:
        """(text, cosine, template, first word, end) for each run of words as long as a template, at
        any place of a text, whose cosine with it is `least` or more: notices wrapped over lines.

        The inner product with one template is a difference of two running sums; so is a bound of
        the norm, which repeated words only raise. Runs that reach `least` by it are compared exactly.
        """
        inside = at >= BUCKETS
        if not inside.any():
            return
        w = self.weights[at]
        energy = np.append(0, np.cumsum(w * w))
        ends = np.cumsum(n)
        last_of = np.repeat(ends, n)
        row_of = np.repeat(np.arange(len(n)), n)
        pos = np.flatnonzero(inside)
        term = at[pos] - BUCKETS
        for k, size in enumerate(self.size.tolist()):
            gain = self.gain[k, term]
            on = gain > 0
            start = pos[on]
            run = np.append(0, np.cumsum(gain[on]))
            stop = np.minimum(start + size, last_of[start])
            dot = run[np.searchsorted(start, stop)] - run[:-1]
            near = dot >= least * np.sqrt(np.maximum(energy[stop] - energy[start], 1e-12)) * (1 - 1e-9)
            for i, j in slices((stop - start)[near].tolist(), 1 << 20):
                a, b = start[near][i:j], stop[near][i:j]
                m = b - a
                own = np.repeat(np.arange(len(a)), m)
                flat = at[np.arange(len(own)) - (np.cumsum(m) - m)[own] + a[own]]
                hit, cos = self.cosines(flat, own, len(a), least)
                for x, c in zip(hit.tolist(), cos[:, k].tolist(), strict=True):
                    if c >= least:
                        yield int(row_of[a[x]]), c, k, int(a[x]), int(b[x])


def license_texts(files: DataFrame, path: str = "path", text: str = "text", doc_id: str = "doc_id", templates: dict[str, list[str]] | None = None, header: float = 0.7, whole: float = 0.5) -> DataFrame:
    """doc_id, path, `license`, `cosine`, `line` (what matched) and `licence_file` for each row.

    Each line of the text, each run of words as long as a template (wherever it starts, so that
    notices wrapped over lines are found) and the text as a whole are compared with each template.
    The line or run with the greatest cosine counts from `header` on: a line before a run, the
    first template and then the first place among equals; `line` is the line, or the lines that the
    run touches with a space between. A licence file is one whose path is named like it, or whose whole text
    reaches `whole`. Document frequencies are over all rows.
    """
    model = Templates(templates or TEMPLATES, *bucket_frequencies(files, text))
    d = pick(files, doc_id=doc_id, path=path, text=text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Terms(BUCKETS, model.terms)
        for b in batches:
            texts = b.column("text").to_pylist()
            for i, j in slices([len(t or "") for t in texts], 2_000_000):
                cells = judged(known, [t or "" for t in texts[i:j]])
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(i, j - i), b.column("path").slice(i, j - i), pa.array([c[0] for c in cells], pa.string()), pa.array([c[1] for c in cells], pa.float64()), pa.array([c[2] for c in cells], pa.string()), pa.array([c[3] for c in cells], pa.bool_())],
                    names=["doc_id", "path", "license", "cosine", "line", "entire"],
                )

    def judged(known: Terms, texts: list[str]) -> list[tuple[str | None, float | None, str | None, bool]]:
        lines = [t.split("\n") for t in texts]
        flat = [x for own in lines for x in own]
        at, n = known.tokens(flat)
        each = np.array([len(x) for x in lines])
        first = np.append(0, np.cumsum(each))
        whole_n = np.add.reduceat(n, first[:-1]) if len(lines) else n
        row_of = np.repeat(np.arange(len(lines)), each)
        entire = model.best(at, whole_n, whole)
        best: dict[int, tuple[tuple[float, int, int, int], str]] = {}

        def offer(r: int, rank: tuple[float, int, int, int], where: slice) -> None:
            if r not in best or rank > best[r][0]:
                best[r] = rank, " ".join(x.strip() for x in flat[where])

        for k, (cos, top) in model.best(at, n, header).items():
            offer(int(row_of[k]), (round(cos, 9), 1, -top, -k), slice(k, k + 1))
        line_ends = np.cumsum(n)
        for r, cos, top, start, stop in model.windows(at, whole_n, header):
            a, z = np.searchsorted(line_ends, [start, stop - 1], side="right")
            offer(r, (round(cos, 9), 0, -top, -start), slice(a, z + 1))
        cells = []
        for r in range(len(texts)):
            if r in best:
                (cos, _, top, _), line = best[r]
                cells.append((model.names[-top], cos, line, r in entire))
            elif r in entire:
                cells.append((model.names[entire[r][1]], round(entire[r][0], 9), None, True))
            else:
                cells.append((None, None, None, False))
        return cells

    kind = d.schema["doc_id"].dataType.simpleString()
    own = d.mapInArrow(lean(run), f"doc_id {kind}, path string, license string, cosine double, line string, entire boolean")
    named = F.coalesce(F.col("path").rlike(FILE_NAME), F.lit(False))
    return own.select("doc_id", "path", "license", "cosine", "line", (F.col("license").isNotNull() & (F.col("entire") | named)).alias("licence_file"))


def directory(path: Column) -> Column:
    """What comes before the last '/', '' at the top."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def ancestors(folder: Column) -> Column:
    """The folder and all above it, up to ''."""
    parts = F.split(folder, "/")
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/")))


def license_scan(files: DataFrame, path: str = "path", text: str = "text", doc_id: str = "doc_id", **how: float) -> DataFrame:
    """doc_id, path, `license`, `cosine`, `line` and `via`: 'own' for a licence in the file itself,
    'inherited' from the nearest directory above it (its own first) that has a licence file, with
    `from_path`, or 'none'.

    Of several licence files in a directory the one with the greatest cosine counts, then the
    lowest path. One row for each row; a NULL path inherits nothing; NULL, empty and wordless texts
    have no licence of their own. Directories, not files, meet in the join that looks upwards.
    """
    own = cut(license_texts(files, path, text, doc_id, **how))
    placed = own.withColumn("folder", directory(F.col("path")))
    held = placed.where("licence_file AND folder IS NOT NULL").groupBy("folder").agg(F.min_by(F.struct("path", "license"), F.struct(-F.col("cosine"), F.col("path"), F.col("license"))).alias("x"))
    folders = placed.where("license IS NULL AND folder IS NOT NULL").select("folder").distinct()
    above = folders.select("folder", F.explode(ancestors(F.col("folder"))).alias("up"))
    near = above.join(held.withColumnRenamed("folder", "up"), "up").groupBy("folder").agg(F.max_by("x", F.length("up")).alias("near"))
    out = placed.join(near, "folder", "left")
    mine = F.col("license").isNotNull()
    return out.select(
        "doc_id", "path",
        F.when(mine, F.col("license")).otherwise(F.col("near.license")).alias("license"),
        "cosine", "line",
        F.when(mine, "own").when(F.col("near").isNotNull(), "inherited").otherwise("none").alias("via"),
        F.when(~mine, F.col("near.path")).alias("from_path"),
    )
