"""Licence scans (7): a trained paragraph classifier, confirmed by comparison with templates.

Sparse word n-grams (one and two words) feed a multinomial logistic regression over licence families and a class for
everything else. It is trained here, on deterministic variations of the templates below and of sentences that merely use
their words; held-out variations calibrate its probabilities by a temperature.

Every word of a text is read. A paragraph is a run of lines without a blank one; it is judged line by line and, so that a notice
is found however it is wrapped and whatever stands around it, in windows of two sizes that overlap by half. The score of a unit
is linear in its n-grams, so units are differences of running sums: no feature matrix is ever made. A predicted unit counts as
confirmed if most of the word pairs of one of the family's templates stand close together in it; those give the notice's place.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNKNOWN = "unknown"

#: Usual notices of each family, in natural order. {year} {holder} {version} stand for what varies.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.", "This project is licensed under the terms of the MIT license.", "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the software.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.", "Released under the Apache License 2.0.", "You may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, without warranties or conditions of any kind.",
    ),
    "BSD": (
        "Licensed under the BSD license.", "Released under the 3-clause BSD License.", "Use of this source code is governed by a BSD-style license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version {version}.", "Licensed under the GNU GPL version {version} or later.", "Released under the GPL.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ),
    "LGPL": (
        "Licensed under the GNU Lesser General Public License, version {version}.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
    ),
    "AGPL": (
        "Licensed under the GNU Affero General Public License, version {version}.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ),
    "MPL-2.0": (
        "Licensed under the Mozilla Public License, version 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ),
    "CC-BY": (
        "Licensed under CC BY {version}.", "This work is licensed under a Creative Commons Attribution {version} International License.",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA {version}.", "This work is licensed under a Creative Commons Attribution-ShareAlike {version} International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC {version}.", "This work is licensed under a Creative Commons Attribution-NonCommercial {version} International License.",
    ),
    "CC0": (
        "Dedicated to the public domain under CC0 {version}.", "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.", "Released into the public domain under the Unlicense.", "Licensed under the Unlicense.",
    ),
    "ISC": (
        "Licensed under the ISC License.", "Released under the ISC license.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "EPL-2.0": (
        "Licensed under the Eclipse Public License, version 2.0.", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
    ),
    "proprietary": (
        "All rights reserved.", "Copyright {year} {holder}. All rights reserved.", "Copyright (c) {year} {holder}. All Rights Reserved.",
        "No part of this publication may be reproduced, distributed or transmitted in any form without the prior written permission of the publisher.",
    ),
}
#: Sentences that use the same words and are no licence.
OTHERS = (
    "He lost his driving license in the storm and had to apply for a new one.", "The license plate of the car was covered with mud.",
    "She asked for permission to leave the room.", "The committee reserved all rooms on the second floor for the guests.",
    "Civil rights were debated in the public square.", "The general public was invited to the opening of the park.",
    "Copyright law was the subject of the lecture.", "They may not use this entrance after ten.", "The version of the story that he told was longer.",
    "Free software was discussed at the meeting.", "A copy of the report was sent to each member.", "The mit of the baker hung on the wall.",
    "The apache helicopter landed behind the hangar.", "Common attributes were listed in the table.", "The work was released to the newspapers in the spring.",
    "All members agreed on the terms.", "Under the bridge the water was still.", "The domain of the function is the set of all numbers.",
    "The commons were open to every farmer.", "The foundation was laid in the year of the flood.", "Terms and conditions of employment were posted at the door.",
    "Licensed under the Boost Software License, Version 1.0.", "Use of this software is governed by the Business Source License included in the LICENSE file.",
    "This software is provided as-is, without any express or implied warranty.", "Licensed under the zlib license.", "Released under the terms of a license of our own.",
    "The author reserved judgement.", "He was licensed to practise medicine in two states.", "The publisher printed the second form of the book.",
)
_WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")
#: Words of the windows in which a paragraph of several lines, or a long one, is read.
WINDOWS = (20, 60)
#: The least probability; the share of a template's word pairs that confirm it; the most words between two of those.
LEAST, CONFIRMED, GAP = 0.5, 0.7, 6
#: Words that turn a notice into its opposite, so many words before it at most (fixed values).
NEGATIONS, REACH = frozenset(("not", "never", "no", "cannot", "neither", "nor", "isn", "aren", "wasn")), 4
#: Characters of text that one step of running sums covers, or one longer text.
STEP_CHARS = 400_000


def words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def grams(ws: list[str]) -> list[str]:
    return ws + [f"{a} {b}" for a, b in zip(ws, ws[1:])]


def _filled(template: str, r: random.Random) -> str:
    holder = " ".join(r.choice(("acme", "north", "lake", "stone", "river", "labs", "press", "group")) for _ in range(r.randint(1, 2)))
    return template.format(year=r.randint(1985, 2030), holder=holder, version=r.choice(("2.0", "3.0", "4.0", "3", "2"))) if "{" in template else template


def _varied(text: str, r: random.Random, known: list[str]) -> list[str]:
    """Some words left out, some others put in, some of the surrounding prose taken along."""
    out = [w for w in words(text) if r.random() > 0.06]
    most = r.choice((0, 6, 6, 40))
    around = lambda: ["".join(r.choice("aeiourtnslmd") for _ in range(r.randint(2, 9))) if r.random() < 0.8 else r.choice(known) for _ in range(r.randint(0, most))]
    return around() + out + around()


@dataclass(frozen=True)
class LicenceModel:
    families: tuple[str, ...]  #: the last is UNKNOWN
    words: dict[str, int]  #: numbers of the words in the vocabulary, from 1
    single: np.ndarray  #: (words + 1, families): weights of a word
    double: np.ndarray  #: (word pairs + 1, families): weights of a word pair
    pair_of: np.ndarray  #: (words + 1, words + 1): number of a pair of words, 0 for none
    rest: np.ndarray  #: (2, families): weights of the share of unknown words, and a constant
    temperature: float
    templates: tuple[tuple[str, frozenset[tuple[str, str]]], ...]  #: (family, word pairs of a template)

    def probabilities(self, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of each unit ids[start:end] (not empty) the probability of every family."""
        k = len(self.families)
        single = np.concatenate([np.zeros((1, k)), np.cumsum(self.single[ids], axis=0)])
        double = np.concatenate([np.zeros((1, k)), np.cumsum(self.double[self.pair_of[ids[:-1], ids[1:]]], axis=0)])
        strange = np.concatenate([[0], np.cumsum(ids == 0)])
        n = (ends - starts).astype(float)
        z = (single[ends] - single[starts] + double[ends - 1] - double[starts]) * (2 / np.sqrt(n))[:, None]
        z += ((strange[ends] - strange[starts]) / n)[:, None] * self.rest[0] + self.rest[1]
        return _softmax(z / self.temperature)

    def confirmed(self, family: str, ws: list[str]) -> tuple[float, int, int]:
        """(share, first, last + 1): the greatest share of a template's word pairs that stand together in the words, over the
        family's templates, and the shortest place that has them. Of equal ones the first."""
        best = (0.0, 0, 0)
        pairs = list(zip(ws, ws[1:]))
        for f, wanted in self.templates:
            if f == family:
                at = [i for i, p in enumerate(pairs) if p in wanted]
                for run in _runs(at):
                    share = len({pairs[i] for i in run}) / len(wanted)
                    if share > best[0]:
                        first, last = _shortest([pairs[i] for i in run], run)
                        best = (share, first, last + 2)
        return best

    def scan(self, text: str | None) -> list[tuple[int, int, str, float, float]]:
        """(start, end, family, probability, share) of every notice of the whole text, in its order; positions are code points."""
        return self.scan_all([text])[0]

    def scan_all(self, texts: list[str | None]) -> list[list[tuple[int, int, str, float, float]]]:
        out: list = [[] for _ in texts]
        for a, b in _steps(texts):
            self._scan_step(texts[a:b], out[a:b])
        return out

    def _scan_step(self, texts: list[str | None], out: list[list]) -> None:
        number, ids, lines, starts, ends, of = self.words.get, [], [], [], [], []
        for i, text in enumerate(texts):
            first, begin, at, part = len(ids), len(ids), 0, 0  # part: lines of the paragraph so far

            def close(begin: int, part: int) -> None:
                n = len(ids) - begin
                for size in WINDOWS:
                    if n > size or (part > 1 and size == WINDOWS[-1] and n):
                        for a in range(begin, begin + max(1, n - size // 2), size // 2):
                            starts.append(a)
                            ends.append(min(a + size, begin + n))
                            of.append((i, begin))  # noqa: B023

            for line in (text or "").split("\n"):
                own = _WORD.findall(line)
                if not own and not line.strip():
                    close(begin, part)
                    begin, part = len(ids), 0
                else:
                    part += 1
                    if own:
                        lines.append((len(ids), at))
                        starts.append(len(ids))
                        ids += [number(w.lower(), 0) for w in own]
                        ends.append(len(ids))
                        of.append((i, begin))
                at += len(line) + 1
            close(begin, part)
            if len(ids) > first:
                lines.append((len(ids), at))
        if not starts:
            return
        a, b = np.array(starts), np.array(ends)
        p = np.concatenate([self.probabilities(np.array(ids), a[x : x + 50_000], b[x : x + 50_000]) for x in range(0, len(a), 50_000)])
        best = p[:, :-1].argmax(axis=1)
        found: dict[int, list] = {}
        places = [x for x, _ in lines]
        for u in np.nonzero(p[np.arange(len(p)), best] >= LEAST)[0].tolist():
            i, begin = of[u]
            begin = max(begin, starts[u] - REACH)
            ws, spans = self._unit(texts[i], lines, places, begin, ends[u])
            skip = starts[u] - begin
            share, x, y = self.confirmed(self.families[best[u]], ws[skip:])
            x, y = x + skip, y + skip
            if share >= CONFIRMED and not NEGATIONS & set(ws[max(0, x - REACH) : x]):
                found.setdefault(i, []).append((-share, -float(p[u, best[u]]), spans[x][0], spans[y - 1][1], self.families[best[u]]))
        for i, units in found.items():
            taken: list = []
            for share, chance, x, y, family in sorted(units):
                if all(y <= c or x >= d for c, d, *_ in taken):
                    taken.append((x, y, family, -chance, -share))
            out[i].extend(sorted(taken))

    @staticmethod
    def _unit(text: str, lines: list, places: list, begin: int, end: int) -> tuple[list[str], list[tuple[int, int]]]:
        """The words from begin to end with their places in the text. lines: (number of the first word, place) of each line."""
        ws, spans, k = [], [], bisect_right(places, begin) - 1
        while lines[k][0] < end:
            at = lines[k][1]
            stop = text.find("\n", at)
            for m in _WORD.finditer(text, at, len(text) if stop < 0 else stop):
                ws.append(m.group().lower())
                spans.append(m.span())
            k += 1
        skip = begin - lines[bisect_right(places, begin) - 1][0]
        return ws[skip : skip + end - begin], spans[skip : skip + end - begin]


def _runs(at: list[int]) -> list[list[int]]:
    """Ascending numbers cut where more than GAP lies between two of them."""
    out: list[list[int]] = []
    for i in at:
        if out and i - out[-1][-1] <= GAP:
            out[-1].append(i)
        else:
            out.append([i])
    return out


def _shortest(pairs: list, at: list[int]) -> tuple[int, int]:
    """Where the shortest stretch begins and ends that has every one of the pairs, which stand at ascending places: of a notice
    that is repeated, one copy. Of equally short ones the first."""
    every, seen, left, best = len(set(pairs)), {}, 0, (at[0], at[-1])
    for right, pair in enumerate(pairs):
        seen[pair] = seen.get(pair, 0) + 1
        while len(seen) == every:
            if at[right] - at[left] < best[1] - best[0]:
                best = (at[left], at[right])
            seen[pairs[left]] -= 1
            if not seen[pairs[left]]:
                del seen[pairs[left]]
            left += 1
    return best


def _steps(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    a = size = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if size and size + n > STEP_CHARS:
            yield a, i
            a, size = i, 0
        size += n
    yield a, len(texts)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _features(units: list[list[str]], vocabulary: dict[str, int]) -> np.ndarray:
    """Of the training units alone. One row for each: how often each known n-gram occurs, times 2 over the square root of the
    words; the share of unknown words; 1."""
    x = np.zeros((len(units), len(vocabulary) + 2))
    for row, ws in zip(x, units):
        for g in grams(ws):
            if g in vocabulary:
                row[vocabulary[g]] += 2 / np.sqrt(max(1, len(ws)))
        row[-2] = sum(w not in vocabulary for w in ws) / max(1, len(ws))
        row[-1] = 1
    return x


@cache
def trained(per_template: int = 24, steps: int = 300, seed: int = 7) -> LicenceModel:
    """The model; the same at every call and on every machine."""
    r = random.Random(seed)
    families = (*TEMPLATES, UNKNOWN)
    base = [(f, t) for f, ts in TEMPLATES.items() for t in ts] + [(UNKNOWN, t) for t in OTHERS]
    known = sorted({w for _, t in base for w in words(t)})
    rows = [(families.index(f), _varied(_filled(t, r), r, known)) for f, t in base for _ in range(per_template)]
    rows += [(len(families) - 1, r.sample(known, r.randint(1, 12))) for _ in range(20 * per_template)]
    rows += [(len(families) - 1, ["".join(r.choice("aeiourtnslmd") for _ in range(r.randint(2, 9))) for _ in range(r.randint(1, 60))]) for _ in range(10 * per_template)]
    r.shuffle(rows)
    vocabulary = {g: i for i, g in enumerate(sorted({g for _, t in base for g in grams(words(t))}))}
    x, y = _features([ws for _, ws in rows], vocabulary), np.array([f for f, _ in rows])
    held = np.arange(len(y)) % 5 == 0
    target = np.eye(len(families))[y]
    w = np.zeros((x.shape[1], len(families)))
    speed = np.zeros_like(w)
    a, b = x[~held], target[~held]
    for _ in range(steps):
        speed = 0.9 * speed - 1.0 * (a.T @ (_softmax(a @ w) - b) / len(a) + 1e-4 * w)
        w += speed
    z = x[held] @ w
    loss = lambda t: -np.log(np.maximum(_softmax(z / t)[np.arange(held.sum()), y[held]], 1e-12)).mean()
    temperature = min((0.5 * 1.1**k for k in range(20)), key=loss)

    number = {g: i + 1 for i, g in enumerate(g for g in vocabulary if " " not in g)}
    none = np.zeros((1, len(families)))
    doubles = [g for g in vocabulary if " " in g]
    pair_of = np.zeros((len(number) + 1, len(number) + 1), np.int32)
    for i, g in enumerate(doubles):
        p, q = g.split(" ")
        pair_of[number[p], number[q]] = i + 1
    weights = lambda gs: np.concatenate([none, w[[vocabulary[g] for g in gs]]])
    varies = {"year", "holder", "version"}
    templates = []
    for f, ts in TEMPLATES.items():
        for t in ts:
            ws = words(t)
            templates.append((f, frozenset(p for p in zip(ws, ws[1:]) if "{" not in t or not varies & set(p))))
    return LicenceModel(families, number, weights(number), weights(doubles), pair_of, w[-2:], temperature, tuple(templates))


def with_licences(docs: DataFrame, model: LicenceModel, name: str = "licences", text_col: str = "text") -> DataFrame:
    """docs with an array of (start, end, family, probability, overlap), one for each confirmed notice, in the order of the
    text; no shuffle. Positions are code points of the text as it is. Null and empty texts have none; long texts are read whole,
    their running sums a step of STEP_CHARS or one text at a time; repeated rows are judged alike; of notices that overlap the
    best confirmed one counts, then the likeliest, then the first; an empty table stays empty; the other columns of docs, whatever
    their names, stay as they are, but for one called name, which is replaced."""
    kind = "array<struct<start: long, end: long, family: string, probability: double, overlap: double>>"

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = ("start", "end", "family", "probability", "overlap")
        for texts in batches:
            yield pd.Series([[dict(zip(names, x)) for x in found] for found in model.scan_all(texts.tolist())], dtype="object")

    return docs.withColumn(name, run(F.col(text_col)))


def op7_licence_scans(spark, sf_dir: str) -> DataFrame:
    """-> (doc_id, n_notices, families, start, stop, probability): how many licence paragraphs a document has, their distinct
    families in alphabetical order, and the place and probability of the first. Documents without any have nulls there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = with_licences(docs, trained()).select("doc_id", "licences")
    first = F.get("licences", 0)
    families = F.array_join(F.array_sort(F.array_distinct(F.transform("licences", lambda x: x["family"]))), ",")
    return out.select(
        "doc_id", F.size("licences").cast("long").alias("n_notices"), F.when(F.size("licences") > 0, families).alias("families"),
        first["start"].alias("start"), first["end"].alias("stop"), first["probability"].alias("probability"),
    )
