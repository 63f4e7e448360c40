"""License scans by conditional compression.

Candidates are the sentences and the blocks of neighbouring lines that speak of licensing; a blank
line ends a block, a wrapped line goes on in the next.  Each is compressed alone and once per
template with the template as a raw zstandard dictionary; a template that says the same saves
bytes.  Every template that does is confirmed by comparing words one by one, and the exact
differences are reported.  Documents without a candidate never leave the JVM.
"""

from __future__ import annotations

import difflib
import functools

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.columns import documents

#: Wordings of public licenses and of notices that name them.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    # notices in one sentence
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("ISC", "Released under the ISC License."),
    ("BSD", "Released under the BSD License."),
    # paragraphs of notices and of short licenses
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BSD", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
)
MARKERS = r"(?i)licen[sc]e|copyright|permission\W+is\W+hereby|redistribution\W+and\W+use"
#: Characters kept on both sides of a marker where a sentence or a block is longer than both together.
AROUND, AROUND_BLOCK = 150, 1000
#: Least share of bytes saved, and largest share of words that may differ.
LEAST_SAVED, MOST_DIFFERENT = 0.08, 0.25
LEVEL = 6

MARKED = regex.compile(MARKERS)
WORDS = regex.compile(r"[\w.-]*\w")
SENTENCE = regex.compile(r"(?s).+?(?:[.!?]+(?=\s)|$)")
LINE, BLOCK = regex.compile(r"[^\n]+"), regex.compile(r"(?:[^\n\w]*\w[^\n]*(?:\n|$))+")
OUT = "doc_id {id}, license string, start long, text string, saved double, n_different long, differences array<string>"


@functools.lru_cache(4)
def _coders(templates):
    plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
    mark = [zstandard.ZstdCompressionDict(t.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT) for _, t in templates]
    return plain, [zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False) for d in mark]


def _laid(template: str, text: str) -> tuple[list[str], list[str], list[tuple[int, int]]]:
    """Words of both, the text's where the template lies, and their places in it."""
    a = [w.lower() for w in WORDS.findall(template)]
    found = [(m[0].lower(), m.span()) for m in WORDS.finditer(text)]
    run = difflib.SequenceMatcher(None, a, [w for w, _ in found], autojunk=False).find_longest_match()
    first = max(0, run.b - run.a)
    found = found[first : first + len(a)]
    return a, [w for w, _ in found], [p for _, p in found]


def _differences(a: list[str], b: list[str]) -> tuple[list[str], list[tuple[int, int]]]:
    """What differs, and the runs of ``b`` that do not."""
    codes = difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes()
    return [f"-{' '.join(a[i:j])} +{' '.join(b[k:m])}" for op, i, j, k, m in codes if op != "equal"], [(k, m) for op, _, _, k, m in codes if op == "equal"]


def differences(template: str, text: str) -> list[str]:
    """Words that differ, ``-template +text``, in order; case and punctuation do not count.

    The template is laid on the text at their longest common run of words; what stands before and
    after it is not compared.
    """
    a, b, _ = _laid(template, text)
    return _differences(a, b)[0]


def _around(text: str, reach: int) -> list[tuple[int, str]]:
    """The text if it holds a marker, or the surroundings of its markers if it is long."""
    out, done = [], 0
    for m in MARKED.finditer(text):
        if m.start() >= done:
            short = len(text) <= 2 * reach
            start = 0 if short else max(done, m.start() - reach)
            done = len(text) if short else m.end() + reach
            block = text[start:done]
            out.append((start + len(block) - len(block.lstrip()), block.strip()))
    return out


def candidates(text: str) -> list[list[tuple[int, str]]]:
    """For each block of lines that holds a marker, start and text of its candidates.

    These are the sentences of a line, the sentences that run over lines, and the block itself.
    """
    out = []
    for block in BLOCK.finditer(text):
        if not MARKED.search(block[0]):
            continue
        got = []
        for line in LINE.finditer(block[0]):
            if MARKED.search(line[0]):
                got += [(line.start() + s.start() + k, t) for s in SENTENCE.finditer(line[0]) for k, t in _around(s[0], AROUND)]
        got += [(s.start() + k, t) for s in SENTENCE.finditer(block[0]) for k, t in _around(s[0], AROUND)]
        got += _around(block[0], AROUND_BLOCK)
        out.append([(block.start() + k, t) for k, t in dict.fromkeys(got)])
    return out


@functools.lru_cache(4)
def _n_words(templates):
    return [len(WORDS.findall(t)) for _, t in templates]


def confirmed(text: str, templates=TEMPLATES):
    """All confirmed templates of a candidate: words alike, words that differ, license, first and last character, share saved, differences."""
    plain, coders = _coders(templates)
    data, n = text.encode(), len(WORDS.findall(text))
    alone = len(plain.compress(data))
    found = []
    for (name, wording), c, size in zip(templates, coders, _n_words(templates)):
        if size - n > MOST_DIFFERENT * size:  # so many words are missing
            continue
        share = 1 - len(c.compress(data)) / alone
        if share < LEAST_SAVED:
            continue
        a, b, places = _laid(wording, text)
        diff, alike = _differences(a, b)
        changed = sum(max(len(x.split()) for x in d[1:].split(" +", 1)) for d in diff)
        if alike and changed <= MOST_DIFFERENT * size:
            found.append((sum(m - k for k, m in alike), changed, name, places[alike[0][0]][0], places[alike[-1][1] - 1][1], share, diff))
    return found


def notices(text: str, templates=TEMPLATES):
    """License, start, text, share saved, words that differ and differences of the notices of a text, in order.

    Where confirmed templates overlap, the one with the most words alike and the fewest that
    differ names the passage; licenses that tie are all told.
    """
    out = []
    for block in candidates(text):
        found = []
        for k, (start, t) in enumerate(block):
            found += [(-n, changed, k, start, t, start + a, start + z, name, share, diff) for n, changed, name, a, z, share, diff in confirmed(t, templates)]
        taken = []
        for f in sorted(found, key=lambda f: f[:3]):
            over = [g for g in taken if f[5] < g[6] and g[5] < f[6]]
            if all(g[:2] == f[:2] and g[7] != f[7] for g in over):
                taken.append(f)
        out += sorted((start, name, t, share, changed, diff) for _, changed, _, start, t, _, _, name, share, diff in taken)
    return [(name, start, t, share, changed, diff) for start, name, t, share, changed, diff in out]


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """One row per confirmed notice: ``doc_id, license, start, text, saved, n_different, differences``.

    ``start`` counts characters.  Null and empty texts have no notice; repeated rows report theirs
    each.
    """
    src = documents(docs).where(F.col("text").rlike(MARKERS))
    schema = T.StructType.fromDDL(OUT.format(id=src.schema["doc_id"].dataType.simpleString()))

    def run(batches):
        for batch in batches:
            rows = []
            for k in range(len(batch)):
                doc = batch.column(0)[k].as_py()
                rows += [(doc, *n) for n in notices(batch.column(1)[k].as_py(), templates)]
            if rows:
                arrays = [pa.array(c) for c in zip(*rows)]
                arrays[0] = arrays[0].cast(batch.column(0).type)
                arrays[6] = pa.array([r[6] for r in rows], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return src.mapInArrow(run, schema)
