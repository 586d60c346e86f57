"""The license scan against the same rules in plain Python."""

import random

import regex

from vantage.llm import licenses as m


def plain_ids(text, ends):
    out = []
    for s in regex.split(ends, text or ""):
        words = regex.sub(r"[^\p{L}\p{N}]+", " ", s).lower().strip()
        if words in m.SENTENCES:
            out.append(m.SENTENCES[words])
    return out


def plain_licenses(ids):
    found, left = [], list(ids)
    for name, want in m.RULES:
        at = 0
        while True:
            places = []
            for w in want:
                try:
                    places.append(left.index(w, places[-1] + 1 if places else at))
                except ValueError:
                    break
            if len(places) < len(want):
                break
            found.append(name)
            left = [None if i in places else x for i, x in enumerate(left)]
            at = places[-1] + 1
    return list(dict.fromkeys(found))


MIT = """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""


def test_against_plain_rules(spark):
    rng = random.Random(1)
    spelt = [s.capitalize() for s in m.SENTENCES] + ["Some other words here", "Warranty void", "licensed"]
    texts = [MIT, None, "", "word " * 50_000 + "\nReleased under the MIT License."]
    for _ in range(400):
        parts = [rng.choice(spelt) + rng.choice([". ", ".\n", "\n\n", "!", ";\n", "\n", " ", ".5 "]) for _ in range(rng.randrange(9))]
        texts.append("".join(parts))
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] * 2 + [(None, "All rights reserved.", "y")], "doc_id long, text string, licenses string")
    got = m.licenses(frame).collect()
    assert len(got) == 2 * len(texts) + 1
    for r in got:
        if r["doc_id"] is None:
            continue
        lines, blocks = plain_ids(texts[r["doc_id"]], m.LINE_END), plain_ids(texts[r["doc_id"]], m.BLOCK_END)
        ids = [x for x in dict.fromkeys(lines) if x not in blocks] + blocks
        assert r["sentence_ids"] == ids
        assert r["licenses"] == plain_licenses(ids)
    assert {tuple(r["licenses"]) for r in got if r["doc_id"] in (0, 3)} == {("MIT",)}


def test_prefilter_lets_every_known_sentence_by():
    words = m.MAY.split("|")
    assert all(any(regex.search(w, s) for w in words) for s in m.SENTENCES)
    assert {w for _, want in m.RULES for w in want} <= set(m.SENTENCES.values())


def test_empty(spark):
    assert m.licenses(spark.createDataFrame([], "doc_id long, text string")).collect() == []


GPL = """This program is free software{0} you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation{1} either version {2} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>."""

MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at {}://mozilla.org/MPL/2.0/."""

APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""

BSD2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""

BSD3 = BSD2 + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""

ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""

HEADERS = [
    (MIT, ["MIT"]), (APACHE, ["Apache-2.0"]), (BSD2, ["BSD-2-Clause"]), (BSD3, ["BSD-3-Clause"]), (ISC, ["ISC"]),
    (MPL.format("http"), ["MPL-2.0"]), (MPL.format("https"), ["MPL-2.0"]),
    *[(GPL.format(a, b, v), [f"GPL-{v}.0-or-later"]) for v in (2, 3) for a in ":;" for b in ",;"]]


LESSER = GPL.replace("GNU General", "GNU Lesser General").replace("This program is", "This library is")
AFFERO = GPL.replace("GNU General", "GNU Affero General")
KERNEL = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License version 2 as
published by the Free Software Foundation."""

HEADERS += [
    *[(LESSER.format(";", b, v), [f"LGPL-{v if v != '3' else '3.0'}-or-later"]) for v in ("2.1", "3") for b in ",;"],
    *[(AFFERO.format(":", b, "3"), ["AGPL-3.0-or-later"]) for b in ",;"], (KERNEL, ["GPL-2.0-only"]),
    (BSD3.replace("copyright holder nor", "University of Somewhere nor"), ["BSD-3-Clause"]),
    (BSD2 + "\n" + BSD3, ["BSD-3-Clause", "BSD-2-Clause"]), (BSD3 + "\n" + MIT, ["MIT", "BSD-3-Clause"]),
    ("SPDX-License-Identifier: MIT", ["MIT"]), ("SPDX-License-Identifier: GPL-2.0+", ["GPL-2.0-or-later"]),
    ("SPDX-License-Identifier: (Apache-2.0 OR MIT) AND BSD-3-Clause", ["Apache-2.0", "BSD-3-Clause", "MIT"]),
    ("SPDX-License-Identifier: GPL-2.0-only WITH Some-exception", ["GPL-2.0-only"]), ("SPDX-License-Identifier: Unknown-1.0", []),
]


def test_copyright_line_directly_above(spark):
    rows = []
    for header, want in HEADERS:
        for line in ("Copyright (c) 2020 A. Person", "© 2019-2021 Some Firm, Inc.", "Copyright 2020 A. Person"):
            for mark in ("", "# ", " * "):
                rows.append(("\n".join(f"{mark}{x}".rstrip() for x in f"{line}\n{header}".split("\n")), want))
    frame = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    for r in m.licenses(frame).collect():
        assert r["licenses"] == rows[r["doc_id"]][1], rows[r["doc_id"]][0]


def test_standard_headers_plain_and_commented(spark):
    rows = []
    for header, want in HEADERS:
        text = f"Copyright (c) 2020 A. Person\n\n{header}"
        rows.append((text, want))
        for mark in ("#", "//", ";;", "--", "%", "REM", "dnl"):
            rows.append(("\n".join(f"{mark} {line}".rstrip() for line in text.split("\n")) + "\n\nx = 1\n", want))
        rows.append(("/*\n" + "\n".join(f" * {line}".rstrip() for line in text.split("\n")) + "\n */\nint x;\n", want))
        rows.append((rows[1][0].replace("\n", "\r\n") if header is MIT else text.replace("\n", "\r\n"), want))
    frame = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    for r in m.licenses(frame).collect():
        assert r["licenses"] == rows[r["doc_id"]][1], rows[r["doc_id"]][0]
