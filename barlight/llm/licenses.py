"""License scan: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

Texts are cut into windows three times as long as the templates of a size class, and overlapping by two thirds, so any passage of up to twice a
template's length lies in one window whole. A window that holds 0.8 of a template's shingles has a Jaccard similarity of at least j with
it; with bands of one minimum each, b bands miss it with probability (1 - j)^b, and b is set so that this stays below MISS for every size
class. Windows without a single template shingle can't share a minimum with any template and are passed over unhashed.

The templates are a table of bounded size, sent to every task; documents are not shuffled.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from barlight.llm.common import slices
from barlight.llm.ngram_join import mixed

SHINGLE = 5
CONTAINMENT = 0.8
MISS = 1e-4
WINDOW = 3

# Public license notices.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "MIT": "Released under the MIT License.",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.',
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}

ALL_NOTICES = {**NOTICES, "All-rights-reserved": "All rights reserved."}
"""With the notices that are shorter than a shingle."""

PUNCTUATION = bytes(b if chr(b).isalnum() or b > 127 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Words of letters and digits, A-Z in lower case."""
    return text.translate(PUNCTUATION).lower().split()


def rolled(hashes: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
    for shift in range(width):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + hashes[shift : shift + len(out)])
    return out


def word_hashes(words: list[bytes]) -> np.ndarray:
    coded = pa.array(words, pa.binary()).dictionary_encode()
    known = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    return known[coded.indices.to_numpy()] if words else np.zeros(0, np.uint64)


class Templates:
    """Templates by size class, and their band tables; templates of fewer words than *width* have no shingle and are left out, see by_width."""

    def __init__(self, notices: dict[str, str], width: int, containment: float, miss: float):
        self.names, self.sets = [], []
        for name, text in notices.items():
            shingles = np.unique(rolled(word_hashes(words_of(text.encode())), width))
            if len(shingles):
                self.names.append(name)
                self.sets.append(shingles)
        self.all = np.unique(np.concatenate([*self.sets, np.zeros(0, np.uint64)]))
        members = defaultdict(list)
        for i, shingles in enumerate(self.sets):
            members[1 << (len(shingles) - 1).bit_length()].append(i)
        self.classes: list[tuple[int, np.ndarray, dict[tuple[int, int], list[int]]]] = []
        for size, held in sorted(members.items()):
            least = min(len(self.sets[i]) for i in held)
            similarity = containment * least / (WINDOW * size + (1 - containment) * least)
            bands = math.ceil(math.log(miss) / math.log(1 - similarity)) if similarity < 1 else 1
            seeds = mixed(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
            table: dict[tuple[int, int], list[int]] = defaultdict(list)
            for i in held:
                for band, low in enumerate(minima(self.sets[i], seeds)):
                    table[band, low].append(i)
            self.classes.append((size, seeds, dict(table)))


def by_width(notices: dict[str, str], width: int, containment: float, miss: float) -> dict[int, Templates]:
    """Templates by the width of their shingles: *width*, or all words of a template that has fewer."""
    parts: dict[int, dict[str, str]] = defaultdict(dict)
    for name, text in notices.items():
        if words := words_of(text.encode()):
            parts[min(width, len(words))][name] = text
    return {w: Templates(part, w, containment, miss) for w, part in sorted(parts.items())}


def minima(shingles: np.ndarray, seeds: np.ndarray) -> list[int]:
    return mixed(shingles[None, :] ^ seeds[:, None]).min(axis=1).tolist()


def scan_text(shingles: np.ndarray, hits: np.ndarray, templates: Templates, containment: float) -> dict[int, tuple[float, int]]:
    """Template: (containment, first word of the window) of the templates that a text holds; hits: positions of template shingles."""
    best: dict[int, tuple[float, int]] = {}
    for size, seeds, table in templates.classes:
        last = np.unique(hits // size)
        for start in np.unique(np.concatenate([last - k for k in range(WINDOW)])).tolist():
            if start < 0:
                continue
            window = np.unique(shingles[start * size : (start + WINDOW) * size])
            found = {i for band, low in enumerate(minima(window, seeds)) for i in table.get((band, low), ())}
            for i in found:
                share = len(np.intersect1d(window, templates.sets[i], assume_unique=True)) / len(templates.sets[i])
                if share >= containment and share > best.get(i, (0.0, 0))[0]:
                    best[i] = share, start * size
    return best


def scan(docs: DataFrame, notices: dict[str, str] = NOTICES, width: int = SHINGLE, containment: float = CONTAINMENT, miss: float = MISS) -> DataFrame:
    """Licenses that documents hold: doc_id, license, containment (0.8 or more), start_word.

    One row for each document and license found, at the first window that holds most of it. A template of fewer words than *width* is one shingle of all its words and found
    where they follow each other. Null and empty texts have none; null ids stay null; repeated rows give repeated rows; an empty table gives an empty one; other columns are ignored.
    """
    source = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    sent = source.sparkSession.sparkContext.broadcast(by_width(notices, width, containment, miss))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            words, borders = [], [0]
            for text in part.column("text").to_pylist():
                words += words_of(text) if text else []
                borders.append(len(words))
            hashes, rows = word_hashes(words), []
            for width, templates in sent.value.items():
                shingles = rolled(hashes, width)
                at = np.minimum(np.searchsorted(templates.all, shingles), len(templates.all) - 1)
                hits = np.flatnonzero(templates.all[at] == shingles)
                doc = np.searchsorted(borders, hits, side="right") - 1
                hits, doc = (x[hits + width <= np.array(borders)[doc + 1]] for x in (hits, doc))  # not across two texts
                for d in np.unique(doc).tolist():
                    start, stop = borders[d], borders[d + 1] - width + 1
                    for i, (share, first) in sorted(scan_text(shingles[start:stop], hits[doc == d] - start, templates, containment).items()):
                        rows.append((d, templates.names[i], share, first))
            columns = [part.column("doc_id").take(pa.array([r[0] for r in rows], pa.int64()))]
            columns += [pa.array([r[k] for r in rows], t) for k, t in ((1, pa.string()), (2, pa.float64()), (3, pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "license", "containment", "start_word"])

    return source.mapInArrow(run, f"doc_id {kind}, license string, containment double, start_word long")
