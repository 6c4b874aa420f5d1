"""Licence scans by sentence rules.

Every sentence of a text is normalised and mapped to the identifier of a known
licence sentence, if it is one. The identifiers of adjacent known sentences form
sequences (an unknown sentence ends a sequence), and ordered rules match runs of
a sequence: the first rule that fits takes its identifiers, so longer texts come
before their parts. Identifiers that no rule takes are reported as unmatched.

A sentence ends at ``.``, ``!``, ``?``, ``;`` or ``:`` before white space, at a
blank line, and at the end, but not inside ``v. 2``. Known sentences go through the
same cut: one that falls into several parts has an identifier for each, and rules
that name it match them all in order. Web addresses, sentences that are only a list
number, and list marks before a sentence are passed over. A sentence may be wrapped over lines; lines before
or after a known sentence within it (a title, a list mark) count as unknown.

Defined cases: null, empty or licence-free text has no identifiers and no
licences; the same licence found twice is listed once; repeated rows give
repeated result rows; texts of any length are read whole; extra columns are
unused.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Sentences of public licence texts and notices, by our identifiers.
SENTENCES = {
    "mit-notice": "Released under the MIT License",
    "mit-licensed": "Licensed under the MIT License",
    "mit-this": "This project is licensed under the MIT License",
    "mit-title": "The MIT License (MIT)",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "mit-keep": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "apache-notice": "Licensed under the Apache License, Version 2.0",
    "apache-licensed": "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "apache-comply": "you may not use this file except in compliance with the License",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-as-is": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "apache-see": "See the License for the specific language governing permissions and limitations under the License",
    "gpl3-work": "This work is licensed under the GNU General Public License, version 3",
    "gpl-free": "This program is free software",
    "gpl2-later": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version",
    "gpl3-later": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "agpl3-later": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "gpl-implied": "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "gpl-details": "See the GNU General Public License for more details",
    "gpl-copy": "You should have received a copy of the GNU General Public License along with this program",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "mpl2-form": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "mpl2-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at",
    "cc-by-nc-4": "Licensed under CC BY-NC 4.0",
    "cc-by-4": "Licensed under CC BY 4.0",
    "cc-by-sa-4": "Licensed under CC BY-SA 4.0",
    "cc0": "Released under CC0 1.0 Universal public domain dedication",
    "cc-by-4-work": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "rights": "All rights reserved under copyright",
    "isc-as-is": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS",
    "isc-liability": "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE",
    "gpl2-later-notice": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "gpl2-only": "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
    "gpl-received": "You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA",
    "agpl-details": "See the GNU Affero General Public License for more details",
    "agpl-copy": "You should have received a copy of the GNU Affero General Public License along with this program",
    "lgpl-free": "This library is free software",
    "lgpl21-later": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    "lgpl3-later": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "lgpl-warranty": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "lgpl-details": "See the GNU Lesser General Public License for more details",
    "lgpl-received": "You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA",
    "lgpl-copy": "You should have received a copy of the GNU Lesser General Public License along with this library",
    "epl2-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "boost-notice": "Distributed under the Boost Software License, Version 1.0",
    "boost-see": "(See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
    "cddl-notice": "The contents of this file are subject to the terms of the Common Development and Distribution License (the \"License\")",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty",
    "zlib-liability": "In no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "apache-title": "Apache License Version 2.0, January 2004",
    "gpl2-title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "gpl3-title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "lgpl21-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "lgpl3-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "agpl3-title": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "mpl2-title": "Mozilla Public License Version 2.0",
    "epl2-title": "Eclipse Public License - v 2.0",
    "boost-title": "Boost Software License - Version 1.0 - August 17th, 2003",
    "isc-title": "ISC License",
    "bsd2-title": "BSD 2-Clause License",
    "bsd3-title": "BSD 3-Clause License",
    "mit-plain-title": "MIT License",
}

# Licences and the identifier runs that state them, in order of trial.
RULES = [
    ("MIT", ("mit-grant", "mit-keep", "mit-as-is", "mit-liability")),
    ("MIT", ("mit-grant", "mit-keep", "mit-as-is")),
    ("ISC", ("isc-grant", "isc-as-is", "isc-liability")),
    ("ISC", ("isc-grant", "mit-as-is")),
    ("ISC", ("isc-grant",)),
    ("Apache-2.0", ("apache-licensed", "apache-comply", "apache-copy", "apache-as-is", "apache-see")),
    ("Apache-2.0", ("apache-licensed", "apache-comply")),
    ("Apache-2.0", ("apache-licensed",)),
    ("Apache-2.0", ("apache-notice",)),
    ("GPL-2.0-or-later", ("gpl-free", "gpl2-later", "gpl-warranty", "gpl-implied", "gpl-details")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl3-later", "gpl-warranty", "gpl-implied", "gpl-details")),
    ("GPL-2.0-or-later", ("gpl-free", "gpl2-later-notice", "gpl-warranty", "gpl-implied", "gpl-details", "gpl-received")),
    ("GPL-2.0-or-later", ("gpl-free", "gpl2-later-notice", "gpl-warranty", "gpl-implied", "gpl-details")),
    ("GPL-2.0-or-later", ("gpl-free", "gpl2-later-notice")),
    ("GPL-2.0-or-later", ("gpl-free", "gpl2-later")),
    ("GPL-2.0-only", ("gpl-free", "gpl2-only", "gpl-warranty", "gpl-implied", "gpl-details")),
    ("GPL-2.0-only", ("gpl-free", "gpl2-only")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl3-later")),
    ("AGPL-3.0-or-later", ("gpl-free", "agpl3-later", "gpl-warranty", "gpl-implied", "agpl-details", "agpl-copy")),
    ("AGPL-3.0-or-later", ("gpl-free", "agpl3-later")),
    ("LGPL-2.1-or-later", ("lgpl-free", "lgpl21-later", "lgpl-warranty", "gpl-implied", "lgpl-details", "lgpl-received")),
    ("LGPL-2.1-or-later", ("lgpl-free", "lgpl21-later")),
    ("LGPL-3.0-or-later", ("lgpl-free", "lgpl3-later", "lgpl-warranty", "gpl-implied", "lgpl-details", "lgpl-copy")),
    ("LGPL-3.0-or-later", ("lgpl-free", "lgpl3-later")),
    ("GPL-3.0-only", ("gpl3-work",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("MPL-2.0", ("mpl2-form", "mpl2-copy")),
    ("MPL-2.0", ("mpl2-form",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4",)),
    ("CC-BY-4.0", ("cc-by-4",)),
    ("CC-BY-4.0", ("cc-by-4-work",)),
    ("CC0-1.0", ("cc0",)),
    ("Unlicense", ("unlicense",)),
    ("EPL-2.0", ("epl2-notice",)),
    ("BSL-1.0", ("boost-notice", "boost-see")),
    ("BSL-1.0", ("boost-notice",)),
    ("CDDL-1.0", ("cddl-notice", "apache-comply")),
    ("CDDL-1.0", ("cddl-notice",)),
    ("Zlib", ("zlib-as-is", "zlib-liability", "zlib-grant")),
    ("Apache-2.0", ("apache-title",)),
    ("GPL-2.0", ("gpl2-title",)),
    ("GPL-3.0", ("gpl3-title",)),
    ("LGPL-2.1", ("lgpl21-title",)),
    ("LGPL-3.0", ("lgpl3-title",)),
    ("AGPL-3.0", ("agpl3-title",)),
    ("MPL-2.0", ("mpl2-title",)),
    ("EPL-2.0", ("epl2-title",)),
    ("BSL-1.0", ("boost-title",)),
    ("ISC", ("isc-title",)),
    ("BSD-2-Clause", ("bsd2-title",)),
    ("BSD-3-Clause", ("bsd3-title",)),
    ("MIT", ("mit-plain-title",)),
    ("MIT", ("mit-title",)),
    ("MIT", ("mit-notice",)),
    ("MIT", ("mit-licensed",)),
    ("MIT", ("mit-this",)),
]

# Every sentence of SENTENCES holds one of these; texts without them are passed over.
ANCHORS = ("licen", "copyright", "warrant", "permission", "redistribut", "public domain", "liab", "free software", "mpl")

_END = re.compile(r"[.!?;:]+(?=\s)(?!(?<=\b[vV]\.)\s+[0-9])|\n[ \t\r]*\n")
_ADDRESS = re.compile(r"(?:https?://|www\.)\S+")
_NUMBER = re.compile(r"[0-9]{1,2}")
_OTHER = re.compile(r"[^0-9a-z]+")
_MARK = re.compile(r"\s*(?:\(?[0-9a-z]{1,2}\)|[0-9]{1,2}\.|[*\u2022-])\s+")
_ANCHOR = re.compile("|".join(a.replace(" ", "[^0-9a-z]+") for a in ANCHORS))


def normalise(sentence: str) -> str:
    """Lower case, letters and digits only, no web addresses or list mark, British spelling of licence made American."""
    lower = sentence.lower()
    mark = _MARK.match(lower)
    return _OTHER.sub(" ", _ADDRESS.sub(" ", lower[mark.end():] if mark else lower)).strip().replace("licence", "license")


def parts(sentence: str) -> list[str]:
    """The normalised sentences that a known sentence falls into."""
    found = [normalise(s) for s in _END.split(sentence)]
    return [s for s in found if s and not _NUMBER.fullmatch(s)]


def _known(sentences: dict[str, str]) -> tuple[dict[str, str], dict[str, int]]:
    """(identifier by normalised sentence, length of the longest sentence by first word).

    A part that an earlier sentence has keeps that one's identifier; whole sentences come first.
    """
    table = {p[0]: name for name, s in sentences.items() if len(p := parts(s)) == 1}
    for name, s in sentences.items():
        for i, part in enumerate(parts(s), 1):
            table.setdefault(part, f"{name}.{i}")
    first: dict[str, int] = {}
    for s in table:
        first[s.split(" ", 1)[0]] = max(first.get(s.split(" ", 1)[0], 0), len(s))
    return table, first


def expanded(rules: list[tuple[str, tuple[str, ...]]], sentences: dict[str, str], table: dict[str, str]) -> list[tuple[str, tuple[str, ...]]]:
    """``rules`` over the identifiers of the sentences' parts; rules of other sentences can't match and are left out."""
    return [(licence, tuple(table[p] for name in run for p in parts(sentences[name]))) for licence, run in rules if set(run) <= set(sentences)]


def anchor(table: dict[str, str]) -> re.Pattern:
    """What a text in lower case holds if it holds a sentence of ``table``: the longest word of each, in both spellings."""
    words = {max(s.split(" "), key=len).replace("license", "licen[cs]e") for s in table}
    return re.compile("|".join(sorted(words)) or "(?!)")


def identify(text: str, table: dict[str, str], first: dict[str, int]) -> list[list[str]]:
    """Sequences of identifiers of adjacent known sentences."""
    sequences: list[list[str]] = [[]]

    def unknown() -> None:
        if sequences[-1]:
            sequences.append([])

    for sentence in _END.split(text):
        whole = normalise(sentence)
        if not whole or _NUMBER.fullmatch(whole):
            continue
        if whole in table:
            sequences[-1].append(table[whole])
            continue
        if "\n" not in sentence.strip():
            unknown()
            continue
        lines = [x for x in map(normalise, sentence.split("\n")) if x]
        at = 0
        while at < len(lines):
            longest, run, found, end = first.get(lines[at].split(" ", 1)[0], 0), "", None, at
            while end < len(lines) and len(run) <= longest:
                run = f"{run} {lines[end]}" if run else lines[end]
                end += 1
                if run in table:
                    found, stop = table[run], end
            if found:
                sequences[-1].append(found)
                at = stop
            else:
                unknown()
                at += 1
    return [s for s in sequences if s]


def match(sequence: list[str], rules: list[tuple[str, tuple[str, ...]]]) -> tuple[list[str], list[str]]:
    """(licences, identifiers that no rule took), both in order of place."""
    taken: list[str | None] = [None] * len(sequence)
    starts: dict[int, str] = {}
    for licence, run in rules:
        n = len(run)
        for i in range(len(sequence) - n + 1):
            if tuple(sequence[i:i + n]) == run and not any(taken[i:i + n]):
                taken[i:i + n] = [licence] * n
                starts[i] = licence
    return [starts[i] for i in sorted(starts)], [s for s, t in zip(sequence, taken) if not t]


def scan_text(text: str, table: dict[str, str], first: dict[str, int], rules: list, anchors: re.Pattern = _ANCHOR) -> tuple[list[str], list[str], list[str]]:
    """(identifiers, licences, unmatched identifiers) of a text."""
    if not anchors.search(text.lower()):
        return [], [], []
    sequences = identify(text, table, first)
    results = [match(s, rules) for s in sequences]
    return [i for s in sequences for i in s], list(dict.fromkeys(x for r in results for x in r[0])), [x for r in results for x in r[1]]


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sentences: dict[str, str] | None = None, rules: list | None = None) -> DataFrame:
    """(doc_id, sentence_ids, licenses, unmatched, n_known), lists joined by commas."""
    given = SENTENCES if sentences is None else sentences
    table, first = _known(given)
    anchors = _ANCHOR if sentences is None else anchor(table)
    rules = expanded(RULES if rules is None else rules, given, table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan_text(t.as_py() or "", table, first, rules, anchors) for t in batch.column(1)]
            columns = [pa.array([",".join(f[i]) for f in found], pa.string()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array([len(f[0]) for f in found], pa.int64())], ["doc_id", "sentence_ids", "licenses", "unmatched", "n_known"])

    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, sentence_ids string, licenses string, unmatched string, n_known long")
