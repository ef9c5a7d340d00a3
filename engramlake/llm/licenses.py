"""License scans over a positional rare-token index of license templates."""

from __future__ import annotations

import math
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from engramlake.llm.common import ChunkCoder, columns, table, words

_DISCLAIMER = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_SPDX = ("Apache-2.0", "MIT", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "MPL-2.0", "EPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Zlib", "BSL-1.0", "0BSD", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0", "Unlicense")
#: (license, template, mandatory key phrases): notices that files carry.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license", "version 2 0")),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", ("apache license", "version 2 0", "in compliance with the license")),
    ("MIT", "Released under the MIT License", ("mit license",)),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", ("permission is hereby granted", "without restriction")),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3", ("gnu general public license", "version 3")),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", ("gnu general public license", "version 3", "any later version")),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version", ("gnu general public license", "version 2", "any later version")),
    ("LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version", ("gnu lesser general public license", "version 2 1")),
    ("AGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", ("gnu affero general public license", "version 3")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/", ("mozilla public license", "v 2 0")),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", ("permission to use copy modify", "with or without fee")),
    ("CC-BY-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0",)),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ("creative commons attribution sharealike 4 0",)),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright", "related or neighboring rights")),
    ("Unlicense", "This is free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
    ("proprietary", "All rights reserved", ("all rights reserved",)),
    ("BSD-3-Clause", _BSD + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _DISCLAIMER, ("redistribution and use in source and binary forms", "neither the name", "endorse or promote")),
    ("BSD-2-Clause", _BSD + " " + _DISCLAIMER, ("redistribution and use in source and binary forms", "provided with the distribution this software is provided by")),
    ("GPL-2.0-only", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation", ("gnu general public license version 2 as published",)),
    ("LGPL-3.0-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version", ("gnu lesser general public license", "version 3", "any later version")),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at", ("eclipse public license 2 0",)),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely", ("permission is granted to anyone", "redistribute it freely")),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0", ("boost software license version 1 0",)),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES", ("is hereby granted the software is provided",)),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ("creative commons attribution noncommercial 4 0",)),
    *((x, f"SPDX-License-Identifier: {x}", (" ".join(words(f"SPDX-License-Identifier: {x}")),)) for x in _SPDX),
)
#: File beside this one, license and key phrases, of texts that are templates in full.
FULL = (
    ("Apache-2.0", "Apache-2.0", ("apache license", "version 2 0 january 2004", "grant of patent license")),
    ("CC0-1.0", "CC0-1.0", ("cc0 1 0 universal", "public license fallback")),
    ("GPL-2", "GPL-2.0", ("gnu general public license", "version 2 june 1991")),
    ("GPL-3", "GPL-3.0", ("gnu general public license", "version 3 29 june 2007")),
    ("LGPL-2.1", "LGPL-2.1", ("gnu lesser general public license", "version 2 1 february 1999")),
    ("LGPL-3", "LGPL-3.0", ("gnu lesser general public license", "version 3 29 june 2007")),
    ("MPL-2.0", "MPL-2.0", ("mozilla public license version 2 0", "covered software")),
)
#: Words of the index that have to agree on a place; the share of a template's words that has to be in place; how far off they may be, and how many words of the template let them be one more off.
RARE, COVER, SLACK, STRETCH = 3, 0.8, 3, 200


def slack(n: int) -> int:
    """How far off words of a template of n words may be: so little that two places of one notice always overlap."""
    return min(SLACK, n // 4) + n // STRETCH


def templates() -> tuple:
    """NOTICES, and the texts of FULL."""
    return (*NOTICES, *((name, (Path(__file__).parent / "license_texts" / f"{f}.txt").read_text(), keys) for f, name, keys in FULL))


class Index:
    """Words of the templates by number; with each word's rarity, postings of the rare ones: word number -> (template, position).

    If COVER of a template's words are in place, then RARE of any of its words are as many as may be out of place and RARE
    more: only so many, a template's rarest, have postings, and no notice is lost for it.
    """

    def __init__(self, templates: tuple):
        self.names = [t[0] for t in templates]
        texts = [words(t[1]) for t in templates]
        phrases = [[words(p) for p in t[2]] for t in templates]
        self.vocabulary = {w: i + 1 for i, w in enumerate(sorted({w for t in texts for w in t} | {w for ps in phrases for p in ps for w in p}))}
        self.texts = [np.array([self.vocabulary[w] for w in t]) for t in texts]
        self.keys = [[np.array([self.vocabulary[w] for w in p]) for p in ps] for ps in phrases]
        self.least = [math.ceil(COVER * len(t)) for t in self.texts]
        self.slack = [slack(len(t)) for t in self.texts]

    def encode(self, chunk: str) -> bytes:
        return np.array([self.vocabulary.get(w, 0) for w in words(chunk)], np.int32).tobytes()

    def post(self, idf: np.ndarray) -> "Index":
        """The index with its postings: template and position, from first[word] to first[word + 1]."""
        posted = []
        for t, (text, least) in enumerate(zip(self.texts, self.least)):
            rare = np.lexsort((np.arange(len(text)), -idf[text]))[: len(text) - least + min(RARE, least)]
            posted.append(np.stack([text[rare], np.full(len(rare), t), rare], 1))
        posted = np.concatenate(posted)
        posted = posted[np.lexsort((posted[:, 2], posted[:, 1], posted[:, 0]))]
        self.first = np.searchsorted(posted[:, 0], np.arange(len(self.vocabulary) + 2))
        self.template, self.position = posted[:, 1], posted[:, 2]
        return self


def word_documents(docs: DataFrame, index: Index) -> np.ndarray:
    """In how many of all documents each word of the templates is, and first the number of documents."""

    def run(batches):
        coder = ChunkCoder(index.encode)
        n, rows = np.zeros(len(index.vocabulary) + 1, np.int64), 0
        for b in batches:
            rows += len(b)
            for text in b["text"]:
                n[np.unique(coder.array(text, np.int32))] += 1
        n[0] = rows
        yield pd.DataFrame({"word": np.arange(len(n)), "n": n})

    rows = docs.select("text").mapInPandas(run, "word int, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(index.vocabulary) + 1, np.int64)
    for r in rows:
        out[r["word"]] = r["n"]
    return out


def _runs(code: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Where phrase begins in code."""
    if len(phrase) > len(code):
        return np.empty(0, np.int64)
    ok = code[: len(code) - len(phrase) + 1] == phrase[0]
    for i in range(1, len(phrase)):
        ok &= code[i : len(code) - len(phrase) + 1 + i] == phrase[i]
    return np.flatnonzero(ok)


def find(code: np.ndarray, index: Index) -> list[tuple[str, int, int, float]]:
    """(license, position, words, cover) for each notice in a document, whose words are given by number.

    A notice begins at s if a word of it has just its place from s, COVER of its words are in the document within the
    template's slack of theirs, and so are all key phrases. The document's words that have postings give (template, place
    less position); where RARE different positions of a template agree to within the slack on either side, each s among
    them is aligned in full. Of overlapping notices the longest counts, then the best covered, then the one with the most
    words just in place, then the first.
    """
    n = index.first[code + 1] - index.first[code]
    at = np.flatnonzero(n)
    if not len(at):
        return []
    n = n[at]
    p = np.repeat(index.first[code[at]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    t, position = index.template[p], index.position[p]
    start = np.repeat(at, n) - position
    order = np.lexsort((start, t))
    t, position, start = t[order], position[order], start[order]
    found: list = []
    for k in np.flatnonzero(np.bincount(t)).tolist():
        lo, hi = np.searchsorted(t, [k, k + 1])
        need, off, text = min(RARE, index.least[k]), index.slack[k], index.texts[k]
        v, pos = start[lo:hi], position[lo:hi]
        if len(v) < need:
            continue
        upto = np.searchsorted(v, v + 2 * off, side="right")
        tries: set[int] = set()
        for i in np.flatnonzero(upto - np.arange(len(v)) >= need).tolist():
            if len(np.unique(pos[i : upto[i]])) >= need:
                # from the last of them that may count to the first
                tries.update(range(int(v[upto[i] - 1]) - off, int(v[i]) + off + 1))
        for s in tries:
            cover, just = _cover(code, text, index.keys[k], s, off)
            if cover >= index.least[k] and just:
                found.append((index.names[k], s, len(text), cover, just))
    return [(name, max(0, s), n, c / n) for name, s, n, c, _ in _longest(found)]


def _cover(code: np.ndarray, text: np.ndarray, keys: list[np.ndarray], s: int, off: int) -> tuple[int, int]:
    """How many of the template's words are within off of their places from s, and just there; none if a key phrase is missing."""
    a, b = max(0, s - off), max(0, min(len(code), s + len(text) + off))
    if not all(len(_runs(code[a:b], key)) for key in keys):
        return 0, 0
    own = np.zeros(len(text) + 2 * off, code.dtype)
    own[a - s + off : b - s + off] = code[a:b]
    near = np.zeros(len(text), bool)
    for d in range(2 * off + 1):
        near |= own[d : d + len(text)] == text
    return int(near.sum()), int((own[off : off + len(text)] == text).sum())


def _longest(found: list[tuple[str, int, int, int, int]]) -> list[tuple[str, int, int, int, int]]:
    """Of notices that overlap, the longest, then the best covered, then the one with the most words just in place, then the first."""
    out: list = []
    for x in sorted(found, key=lambda x: (-x[2], -x[3], -x[4], x[1], x[0])):
        if all(x[1] + x[2] <= y[1] or y[1] + y[2] <= x[1] for y in out):
            out.append(x)
    return sorted(out, key=lambda x: (x[1], x[0]))


def scan(docs: DataFrame, texts: tuple | None = None) -> DataFrame:
    """doc_id, license, position, words, cover: the license notices in all documents, position being the first word's.

    Method: a positional index of the templates' rarest words, by their document counts in all documents; find() looks a
    document's words up in it, intersects the postings by relative position and verifies cover and key phrases.

    A null or empty text has none. A text counts whole, however long. Repeated rows are each scanned; a notice that comes
    several times in a document is reported each time; ties between notices at one place go by cover, then place, then
    name; an empty table gives an empty result; columns other than doc_id and text aren't read, whatever their names.
    """
    index = Index(texts or templates())
    d = columns(docs).select("doc_id", "text")
    n = word_documents(d, index)
    index.post(np.log((n[0] + 1) / (n + 1.0)))

    def run(batches):
        coder = ChunkCoder(index.encode)
        for b in batches:
            rows = [(doc, *x) for doc, text in zip(b["doc_id"], b["text"]) for x in find(coder.array(text, np.int32), index)]
            yield pd.DataFrame(rows, columns=["doc_id", "license", "position", "words", "cover"]).astype({"doc_id": "Int64"})

    return d.mapInPandas(run, "doc_id bigint, license string, position bigint, words bigint, cover double")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, license, position, words and cover of each notice in all documents."""
    return scan(table(spark, sf_dir, "documents"))


SQL: dict[str, str] = {}
QUERIES = {"op8_license_scan": op8_license_scan}
