"""Operator 5, license scans: conditional compression.

A notice that may differ in d words keeps at least one of d + 1 disjoint runs of
its template's words whole, as one difference breaks one run. The runs of all
templates (``RUNS``) therefore decide what is looked at: where a run stands in a
text, the words that the notice could reach before and after it are a candidate
block, and blocks that meet are joined. Each block is
compressed with zstandard alone and with each notice template as a raw-content
dictionary. The templates are ranked by the bytes that they save, and all that
save any are confirmed by exact wording: the template's words are aligned
with the block's, and the words missing from or added inside the matched span
are counted (not aligned: a template of which more words are absent from the
block than may differ). The template with the fewest differences is reported when they are
at most ``TOLERANCE`` of its words; a notice of less than ``LONG_NOTICE`` words
must match word by word. A found span is blanked and the block is ranked again, so a block
gives all its notices.

Every run holds one of the words ``ANCHORS``, chosen from the runs. They are
sought in the JVM over every whole text, and only texts that hold one go to
Python, row by row and without a shuffle.

Defined results: a null or empty text has no blocks; notices that touch each
other are separate; among equally close templates the larger saving wins, then
the first in ``TEMPLATES``; repeated rows each get a row; an empty table gives an empty result. Extra
columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import picked, table

# The customary notices of public licenses.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]

LONGEST = 800  # words of a block
LEAST_SAVED = 1
TOLERANCE = 0.1
LONG_NOTICE = 20
LEVEL = 19

_WORD = re.compile(r"\S+")


def normal_words(text: str) -> list[tuple[str, int, int]]:
    """(word, start, end) without surrounding punctuation, in lower case."""
    out = []
    for m in _WORD.finditer(text):
        word = m[0].strip(".,;:!?()[]{}\"'`*#").lower()
        if word:
            out.append((word, m.start(), m.end()))
    return out


def allowed(n_words: int) -> int:
    """Differing words that a notice of ``n_words`` may have."""
    return int(n_words * TOLERANCE) if n_words >= LONG_NOTICE else 0


def dictionary(words: list[str]) -> bytes:
    """A template as dictionary content: twice, as the compressor doesn't look for matches in a dictionary's last bytes."""
    return " ".join([*words, *words, ""]).encode()


@dataclass(frozen=True)
class Run:
    """Some words of a template, and how many words of a notice may lie before the first and after the last of them."""

    words: tuple[str, ...]
    before: int
    after: int


def runs_of(words: list[str]) -> list[Run]:
    """Disjoint runs of a template, one more than the words in which a notice may differ."""
    d = allowed(len(words))
    cuts = [len(words) * k // (d + 1) for k in range(d + 2)]
    return [Run(tuple(words[a:b]), a + d, len(words) - b + d) for a, b in zip(cuts, cuts[1:])]


def anchors_of(runs: list[Run]) -> list[str]:
    """Words, of six letters or more where a run has such, of which every run holds one."""
    left, out = [set(r.words) for r in runs], []
    while left:
        held = Counter(w for words in left for w in ({x for x in words if len(x) >= 6} or words))
        best = min(held, key=lambda w: (-held[w], -len(w), w))
        out.append(best)
        left = [words for words in left if best not in words]
    return out


RUNS = [run for _, text in TEMPLATES for run in runs_of([w for w, _, _ in normal_words(text)])]
ANCHORS = anchors_of(RUNS)


class Scanner:
    def __init__(self, templates: list[tuple[str, str]] = TEMPLATES):
        self.templates = [(name, [w for w, _, _ in normal_words(text)]) for name, text in templates]
        self.counted = [Counter(words) for _, words in self.templates]
        self.runs: dict[str, list[Run]] = {}
        for run in (r for _, words in self.templates for r in runs_of(words)):
            self.runs.setdefault(run.words[0], []).append(run)
        self.reach = max(len(r.words) + r.before + r.after for some in self.runs.values() for r in some)
        options = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.alone = zstandard.ZstdCompressor(compression_params=options)
        self.given = [
            zstandard.ZstdCompressor(compression_params=options, dict_data=zstandard.ZstdCompressionDict(dictionary(words), dict_type=zstandard.DICT_TYPE_RAWCONTENT))
            for _, words in self.templates
        ]

    def ranked(self, words: list[str]) -> list[tuple[int, int]]:
        """(bytes saved, template), the best first."""
        block = " ".join(["", *words, ""]).encode("utf-8", "replace")
        plain = len(self.alone.compress(block))
        saved = [(plain - len(c.compress(block)), i) for i, c in enumerate(self.given)]
        return sorted((x for x in saved if x[0] >= LEAST_SAVED), key=lambda x: (-x[0], x[1]))

    def differences(self, words: list[str], template: list[str]) -> tuple[int, int, int] | None:
        """(differing words, first, last) of the closest wording of the template in ``words``."""
        runs = [b for b in SequenceMatcher(None, words, template, autojunk=False).get_matching_blocks() if b.size]
        best = None
        for i in range(len(runs)):
            matched = 0
            for j in range(i, len(runs)):
                matched += runs[j].size
                first, last = runs[i].a, runs[j].a + runs[j].size - 1
                count = (len(template) - matched) + (last - first + 1 - matched)
                if best is None or count < best[0]:
                    best = (count, first, last)
        return best

    def notices(self, text: str, start: int, end: int) -> list[tuple[str, int, int, int, int]]:
        """(license, start, end, bytes saved, differing words) of each notice in one block."""
        spans = normal_words(text[start:end])
        words = [w for w, _, _ in spans]
        out = []
        found = True
        while found:
            found, closest = False, None
            held = Counter(words)
            for saved, t in self.ranked(words):
                limit = allowed(len(self.templates[t][1]))
                if (self.counted[t] - held).total() > limit:  # so many words are missing at least
                    continue
                best = self.differences(words, self.templates[t][1])
                if best and best[0] <= limit and (closest is None or best[0] < closest[0]):
                    closest = (*best, saved, self.templates[t][0])
            if closest:
                count, first, last, saved, name = closest
                out.append((name, start + spans[first][1], start + spans[last][2], saved, count))
                words[first:last + 1] = [f"\x00{i}" for i in range(first, last + 1)]
                found = True
        return sorted(out, key=lambda x: x[1])

    def blocks(self, text: str) -> list[tuple[int, int]]:
        """Candidate blocks: the reach of every run that stands in the text, joined where they meet; long ones are cut with an overlap."""
        spans = normal_words(text)
        words = [w for w, _, _ in spans]
        out: list[list[int]] = []
        reaches = [(max(0, i - r.before), min(len(words), i + len(r.words) + r.after)) for i, w in enumerate(words)
                   for r in self.runs.get(w, ()) if tuple(words[i:i + len(r.words)]) == r.words]
        for a, b in sorted(reaches):
            if out and a <= out[-1][1]:
                out[-1][1] = max(b, out[-1][1])
            else:
                out.append([a, b])
        cut = []
        for a, b in out:
            while b - a > LONGEST:
                cut.append((a, a + LONGEST))
                a += LONGEST - self.reach
            cut.append((a, b))
        return [(spans[a][1], spans[b - 1][2]) for a, b in cut]

    def scan(self, text: str) -> tuple[int, list[tuple[str, int, int, int, int]]]:
        blocks = self.blocks(text)
        found: list[tuple[str, int, int, int, int]] = []
        # Blocks cut from a long one overlap: of a notice that the cut shortens, the whole wording stays.
        for notice in sorted((x for a, b in blocks for x in self.notices(text, a, b)), key=lambda x: (x[4], -x[3], x[1])):
            i = bisect_left(found, notice[1], key=lambda x: x[1])
            if (i == 0 or found[i - 1][2] <= notice[1]) and (i == len(found) or notice[2] <= found[i][1]):
                found.insert(i, notice)
        return len(blocks), found


NOTICE = "struct<license: string, start: long, end: long, saved: long, differences: long>"


def _scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner()
    kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("saved", pa.int64()), ("differences", pa.int64())]))
    names = ["license", "start", "end", "saved", "differences"]
    for part in parts:
        rows = [scanner.scan(x) if x else (0, []) for x in part.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array([n for n, _ in rows], pa.int64()), pa.array([[dict(zip(names, x)) for x in found] for _, found in rows], kind)],
            ["doc_id", "n_blocks", "notices"])


def scanned(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_blocks, notices (license, start and end in code points, bytes saved, differing words)."""
    rows = picked(docs, doc_id="long", text="string")
    rows = rows.withColumn("text", F.when(F.col("text").rlike(f"(?iu){'|'.join(map(re.escape, ANCHORS))}"), F.col("text")))
    return rows.mapInArrow(_scan, f"doc_id long, n_blocks long, notices array<{NOTICE}>")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in all of ``documents``, one row per document."""
    out = scanned(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_blocks", F.size("notices").cast("long").alias("n_notices"),
        F.array_join(F.array_sort(F.array_distinct("notices.license")), ",").alias("licenses"),
        F.to_json("notices").alias("notices"))


#: Compression is beyond SQL; the tests hold the notices against a search for every template at every word.
ORACLE_SQL: dict[str, str] = {}
