"""Licences of files: notices found by sparse TF-IDF cosine, then inherited along directories.

Every line, paragraph and run of up to three sentences of a whole text is compared with templates over
the vocabulary of the templates; inverse document frequencies are counted over all files. Words outside the vocabulary
weigh as words that no file has. A segment that shares none of a template's heaviest words cannot
reach the limit and is passed over, which loses nothing. A template counts only where all its names and
numbers occur (one whose names include another's goes before it), and a segment only where no other
licence comes within a margin of the best: a wrong licence is worse than none.

A file without a notice of its own takes the licence of the nearest directory above it that has a
licence file, by joining the ancestors of each distinct directory to the directories with one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch
from .common import stage

# Licence ids with wordings of their notices (the licences' own texts and recommended headers).
NOTICES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
                   "in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation, either version 3 of the License, "
                "or (at your option) any later version."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation; either version 2 of the License, "
                "or (at your option) any later version."),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
                 "Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the "
                 "License, or (at your option) any later version."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                 "Lesser General Public License as published by the Free Software Foundation, either version 3 of the "
                 "License, or (at your option) any later version."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                 "Affero General Public License as published by the Free Software Foundation, either version 3 of the "
                 "License, or (at your option) any later version."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
                     "promote products derived from this software without specific prior written permission."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted "
            "provided that the following conditions are met"),
    ("ISC", "Licensed under the ISC License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights "
                "to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty."),
]
#: Kinds of Creative Commons licences with their long names.
COMMONS = {
    "BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
TEMPLATES: list[tuple[str, str]] = [
    *NOTICES,
    *[(f"CC-{k}-4.0", f"Licensed under CC {k} 4.0.") for k in COMMONS],
    *[(f"CC-{k}-4.0", f"This work is licensed under a Creative Commons {v} 4.0 International License.") for k, v in COMMONS.items()],
]
TEMPLATES += [(x, f"SPDX-License-Identifier: {x}") for x in dict.fromkeys(x for x, _ in TEMPLATES) if x != "BSD"]
#: A wording that several licences share names the family; it gives way to a member found in the same text.
FAMILIES = {"BSD": ("BSD-2-Clause", "BSD-3-Clause")}
WORD = re.compile(r"[^\W_]+(?:[-.+][^\W_]+)*")
SENTENCE = re.compile(r"(?<=[.!?;])\s+")
LICENSE_FILE = r"(?i)(^|/)(licen[cs]e|copying|unlicense)([.-][^/]*)?$"


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def segments(text: str) -> list[str]:
    """Lines, paragraphs of several lines, and runs of up to three sentences of a whole text."""
    out, block = [], []
    for line in [*text.split("\n"), ""]:
        if line.strip():
            out.append(line)
            block.append(line)
            continue
        if len(block) > 1:
            out.append(" ".join(block))
        sentences = SENTENCE.split(" ".join(block)) if block else []
        if len(sentences) > 1:
            out += [" ".join(sentences[i : i + n]) for n in (1, 2, 3) for i in range(len(sentences) - n + 1)]
        block = []
    return out


def names_of(text: str) -> frozenset[str]:
    """Words of a template that name the licence: capitalised after the first word, or with a digit."""
    return frozenset(w.lower() for i, w in enumerate(WORD.findall(text)) if (i and w[0].isupper()) or any(c.isdigit() for c in w))


@dataclass
class Matcher:
    """Template vectors with the inverse document frequencies of their words."""

    templates: list[tuple[str, str]]
    idf: dict[str, float]
    other: float  # of a word outside the vocabulary
    least: float
    margin: float = 0.02

    def __post_init__(self) -> None:
        self.vectors, self.norms, needed = [], [], set()
        for _, text in self.templates:
            tf = Counter(words_of(text))
            v = {w: n * self.idf[w] for w, n in tf.items()}
            norm = float(np.sqrt(sum(x * x for x in v.values()))) or 1.0
            self.vectors.append(v)
            self.norms.append(norm)
            rest = norm * norm
            for w in sorted(v, key=lambda w: (-v[w], w)):
                # Without the words so far, the most that the others can give is below the limit.
                if rest < (self.least * norm) ** 2:
                    break
                needed.add(w)
                rest -= v[w] * v[w]
        self.needed = frozenset(needed)
        self.names = [names_of(text) for _, text in self.templates]

    def score(self, segment: str) -> tuple[float, int]:
        """The best cosine and the number of its template (the first on ties), among templates whose names all occur.

        (best cosine, -1) if another licence comes within the margin of it.
        """
        tf = Counter(words_of(segment))
        weights = {w: n * self.idf.get(w, self.other) for w, n in tf.items()}
        norm = float(np.sqrt(sum(x * x for x in weights.values())))
        by_license: dict[str, tuple[float, int]] = {}
        for k, v in enumerate(self.vectors):
            if not self.names[k] <= tf.keys():
                continue
            dot = sum(x * weights[w] for w, x in v.items() if w in weights)
            cosine = dot / (norm * self.norms[k]) if dot else 0.0
            if cosine > by_license.get(self.templates[k][0], (0.0, -1))[0] + 1e-12:
                by_license[self.templates[k][0]] = cosine, k
        # Names that include all of another's say more: the GNU Affero notice has every name of the GNU one.
        names = {x: self.names[k] for x, (c, k) in by_license.items() if c >= self.least}
        said = [v for x, v in by_license.items() if not any(x in names and names[x] < other for other in names.values())]
        ranked = sorted(said, key=lambda x: (-x[0], x[1]))
        if not ranked:
            return 0.0, -1
        close = len(ranked) > 1 and ranked[0][0] - ranked[1][0] < self.margin
        return ranked[0][0], -1 if close else ranked[0][1]

    def best(self, text: str | None) -> tuple[str | None, float]:
        """Licence and score of the best segment of a text, or (None, best score)."""
        if not text or self.needed.isdisjoint(words_of(text)):
            return None, 0.0
        found: dict[str, tuple[float, int]] = {}
        most = 0.0
        for segment in dict.fromkeys(segments(text)):
            if not self.needed.isdisjoint(words_of(segment)):
                score, k = self.score(segment)
                most = max(most, score)
                if k >= 0 and score >= self.least and score > found.get(self.templates[k][0], (0.0, 0))[0] + 1e-12:
                    found[self.templates[k][0]] = score, k
        for family, members in FAMILIES.items():
            if any(m in found for m in members):
                found.pop(family, None)
        if not found:
            return None, most
        license, (score, _) = min(found.items(), key=lambda x: (-round(x[1][0], 12), x[1][1]))
        return license, score


def fit(files: DataFrame, text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES, least: float = 0.7) -> Matcher:
    """Document frequencies of the templates' words over all files (null texts have no words)."""
    vocabulary = sorted({w for _, t in templates for w in words_of(t)})
    schema = pa.schema([("word", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {w: k for k, w in enumerate(vocabulary)}
        known, seen = frozenset(vocabulary), np.zeros(len(vocabulary) + 1, np.int64)
        for b in batches:
            for text in b.column(0):
                for w in known.intersection(words_of(text.as_py() or "")):
                    seen[place[w]] += 1
            seen[-1] += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(range(len(seen)), pa.int32()), pa.array(seen)], schema=schema)

    rows = files.select(text_col).mapInArrow(run, "word int, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    n = {r.word: r.n for r in rows.collect()}  # one row per word of the templates
    total = n.get(len(vocabulary), 0)
    idf = {w: float(np.log((1 + total) / (1 + n.get(k, 0))) + 1) for k, w in enumerate(vocabulary)}
    return Matcher(list(templates), idf, float(np.log(1 + total) + 1), least)


def own_licenses(files: DataFrame, matcher: Matcher, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """(path, own_license, own_score) per row of `files`."""
    schema = pa.schema([("path", pa.string()), ("own_license", pa.string()), ("own_score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [matcher.best(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays(
                [b.column("path"), pa.array([x for x, _ in found], pa.string()), pa.array([round(s, 9) for _, s in found], pa.float64())],
                schema=schema)

    rows = files.select(F.col(path_col).cast("string").alias("path"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "path string, own_license string, own_score double")


def directory(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES,
         least: float = 0.7, license_file: str = LICENSE_FILE) -> DataFrame:
    """One row per row of `files`: path, own_license, own_score, license, license_dir.

    license is the file's own, else that of the nearest directory above with a licence file; then
    license_dir names the directory ('' is the root). Of several licence files in a directory that
    with the best score counts, on ties the licence that sorts first. A null path has no directory and
    inherits nothing; a null or empty text has no notice; rows that repeat get the same answer; an empty
    table stays empty; other columns are not read.
    """
    found = stage(own_licenses(files, fit(files, text_col, templates, least), path_col, text_col), scratch(files.sparkSession, "licenses"))
    placed = found.withColumn("dir", directory(F.col("path")))
    by_dir = placed.where(F.col("own_license").isNotNull() & F.col("path").rlike(license_file)).groupBy("dir").agg(
        F.min(F.struct((-F.col("own_score")).alias("s"), F.col("own_license").alias("license")))["license"].alias("license"))
    # Ancestors of distinct directories, not of files: a full directory joins as one row.
    parts = F.split("dir", "/")
    up = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    dirs = placed.where("dir is not null").select("dir").distinct()
    above = dirs.select("dir", F.explode(F.array_distinct(up)).alias("at"))
    nearest = above.join(by_dir.withColumnRenamed("dir", "at"), "at").groupBy("dir").agg(
        F.max(F.struct(F.length("at").alias("n"), "at", "license")).alias("x"))
    inherited = stage(nearest.select("dir", F.col("x.at").alias("license_dir"), F.col("x.license").alias("inherited")),
                      scratch(files.sparkSession, "inherited"))
    own = F.col("own_license")
    return placed.join(inherited, "dir", "left").select(
        "path", "own_license", "own_score", F.coalesce(own, "inherited").alias("license"),
        F.when(own.isNull(), F.col("license_dir")).alias("license_dir"))
