import textwrap

from kinweave.llm import licenses as L


def brute(text):
    """Every way to cut the sentences' lines, without tables by first word or early stops."""
    table, _ = L._known(L.SENTENCES)
    sequences = [[]]
    for sentence in L._END.split(text):
        lines = [x for x in map(L.normalise, sentence.split("\n")) if x]
        at = 0
        while at < len(lines):
            hits = [k for k in range(len(lines), at, -1) if " ".join(lines[at:k]) in table]
            if hits:
                sequences[-1].append(table[" ".join(lines[at:hits[0]])])
                at = hits[0]
            else:
                sequences.append([])
                at += 1
    ids, names = [], []
    for s in sequences:
        ids += s
        left = list(s)
        found = []
        for name, run in L.expanded(L.RULES, L.SENTENCES, table):
            i = 0
            while i + len(run) <= len(left):
                if tuple(left[i:i + len(run)]) == run:
                    found.append((i, name))
                    left[i:i + len(run)] = [None] * len(run)
                i += 1
        names += [n for _, n in sorted(found)]
    return ids, list(dict.fromkeys(names))


def cases():
    mit = ". ".join(L.SENTENCES[k] for k in ("mit-grant", "mit-keep", "mit-as-is", "mit-liability")).replace("conditions. The", "conditions:\n\nThe") + "."
    apache = f"{L.SENTENCES['apache-licensed']};\n{L.SENTENCES['apache-comply']}.\n"
    gpl = f"{L.SENTENCES['gpl-free']}: {L.SENTENCES['gpl3-later']}. Unknown words here."
    return [
        None, "", "no such thing.", "Licensed under CC BY-NC 4.0.", "x y\nReleased under the MIT License.\nz", mit, textwrap.fill(mit, 60), apache, "Some Title\n" + textwrap.fill(gpl, 40),
        L.SENTENCES["bsd-grant"] + ". Unknown. " + L.SENTENCES["bsd-source"] + ".", mit + "\n" + mit + "\nLicensed under the Apache Licence, Version 2.0.",
        "A licence\nThis work is licensed under the GNU General Public License, version 3.\nLicensed under CC BY-NC 4.0. licen", "copyright " * 20000,
        L.SENTENCES["gpl-free"] + ".", "MPL\n\n" + L.SENTENCES["mpl2-copy"] + " ",
    ]


def test_every_known_sentence_has_an_anchor_and_a_rule_knows_its_ids():
    table, _ = L._known(L.SENTENCES)
    assert all(L._ANCHOR.search(p) for p in table if "franklin" not in p)
    assert len({tuple(L.parts(s)) for s in L.SENTENCES.values()}) == len(L.SENTENCES)
    assert {i for _, run in L.RULES for i in run} <= set(L.SENTENCES)


def test_matches_brute_force(spark):
    texts = cases()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(3, texts[3], "x")], "doc_id long, text string, licenses string").repartition(3)
    rows = L.scan(df).collect()
    assert sorted(r.doc_id for r in rows) == sorted([*range(len(texts)), 3])
    for r in rows:
        ids, names = brute(texts[r.doc_id] or "")
        assert (r.sentence_ids, r.licenses, r.n_known) == (",".join(ids), ",".join(names), len(ids)), texts[r.doc_id]
    by = {r.doc_id: r for r in rows}
    assert by[5].licenses == by[6].licenses == "MIT" and by[8].licenses == "GPL-3.0-or-later" and by[9].unmatched == "bsd-grant,bsd-source"
    assert by[10].licenses == "MIT,Apache-2.0" and by[13].unmatched == "gpl-free"
    assert L.scan(df.limit(0)).count() == 0


def scanned(text):
    table, first = L._known(L.SENTENCES)
    return L.scan_text(text, table, first, L.expanded(L.RULES, L.SENTENCES, table))


PUBLISHED = {
    "GPL-2.0-or-later": """<one line to give the program's name and an idea of what it does.>
Copyright (C) <yyyy>  <name of author>

This program is free software; you can redistribute it and/or
modify it under the terms of the GNU General Public License
as published by the Free Software Foundation; either version 2
of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program; if not, write to the Free Software
Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA  02110-1301, USA.
""",
    "GPL-3.0-or-later": """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.
""",
    "LGPL-2.1-or-later": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.
""",
    "AGPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.

You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.
""",
    "EPL-2.0": """This program and the accompanying materials are made available under the
terms of the Eclipse Public License 2.0 which is available at
https://www.eclipse.org/legal/epl-2.0/

SPDX-License-Identifier: EPL-2.0
""",
    "BSL-1.0": """         Copyright Joe Coder 2004 - 2006.
Distributed under the Boost Software License, Version 1.0.
   (See accompanying file LICENSE_1_0.txt or copy at
         https://www.boost.org/LICENSE_1_0.txt)
""",
    "ISC": """Copyright <YEAR> <OWNER>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

(a) Redistributions of source code must retain the above copyright notice, this
    list of conditions and the following disclaimer.

(b) Redistributions in binary form must reproduce the above copyright notice,
    this list of conditions and the following disclaimer in the documentation
    and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS".
""",
    "Zlib": """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:
""",
    "CDDL-1.0": """The contents of this file are subject to the terms of the
Common Development and Distribution License (the "License").
You may not use this file except in compliance with the License.
""",
    "GPL-3.0": "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n",
    "Apache-2.0": "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS\n",
    "MPL-2.0": "Mozilla Public License Version 2.0\n==================================\n\n1. Definitions\n",
}


def test_published_notices_wrapped_at_every_width():
    for name, text in PUBLISHED.items():
        assert scanned(text)[1] == [name], name
        blocks = [" ".join(b.split()) for b in text.split("\n\n")]
        for width in (24, 40, 72, 10_000):
            wrapped = "\n\n".join(textwrap.fill(b, width, break_long_words=False, break_on_hyphens=False) for b in blocks if b)
            assert scanned(wrapped)[1] == [name], (name, width)


def test_every_rule_fires_on_its_own_text():
    for name, run in L.RULES:
        assert scanned("\n\n".join(L.SENTENCES[i] + "." for i in run))[1:] == ([name], []), run


def test_standard_notices():
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at http://mozilla.org/MPL/2.0/.\n"
    assert scanned(mpl) == (["mpl2-form", "mpl2-copy"], ["MPL-2.0"], [])
    s = L.SENTENCES
    two = f"Copyright (c) A B\n\n{s['bsd-grant']}:\n\n1. {textwrap.fill(s['bsd-source'], 60)}.\n\n2. {textwrap.fill(s['bsd-binary'], 60)}.\n"
    end = "\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS."
    assert scanned(two + end)[1:] == (["BSD-2-Clause"], [])
    assert scanned(two + f"\n3. {textwrap.fill(s['bsd-endorse'], 60)}.\n" + end)[1:] == (["BSD-3-Clause"], [])
    apache = f"{s['apache-licensed']};\n{s['apache-comply']}.\n{s['apache-copy']}\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\n{s['apache-as-is']}.\n{s['apache-see']}.\n"
    assert scanned(apache)[1:] == (["Apache-2.0"], [])


def test_anchors_of_wrapped_and_of_given_sentences(spark):
    for key in ("cc0", "unlicense", "gpl-free"):
        assert scanned(L.SENTENCES[key].replace("public domain", "public\ndomain").replace("free software", "free \t software") + ".")[0] == [key]
    df = spark.createDataFrame([(0, "Do what\nyou like with it."), (1, "Under the House Licence."), (2, "none")], "doc_id long, text string")
    got = L.scan(df, sentences={"like": "Do what you like with it", "house": "Under the House License"}, rules=[("Like", ("like",))]).collect()
    assert {r.doc_id: (r.sentence_ids, r.licenses, r.unmatched) for r in got} == {0: ("like", "Like", ""), 1: ("house", "", "house"), 2: ("", "", "")}
    assert L.scan(df, sentences={}).filter("n_known > 0").count() == 0
