"""License scan by sentence rules: known sentences become identifiers, identifier sequences match ordered rules.

Everything is column expressions: the scan is one narrow pass without a shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licence texts and notices, normalised, with the identifier of each.
SENTENCES = {
    "released under the mit license": "mit-notice",
    "licensed under the mit license": "mit-notice",
    "this project is licensed under the mit license": "mit-notice",
    "distributed under the mit license": "mit-notice",
    "mit license": "mit-title",
    "the mit license": "mit-title",
    "the mit license mit": "mit-title",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-condition",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit-liability",
    "licensed under the apache license version 2 0": "apache-notice",
    "licensed under the apache license version 2 0 the license": "apache-notice",
    "this project is licensed under the apache license version 2 0": "apache-notice",
    "apache license version 2 0": "apache-title",
    "apache license": "apache-name",
    "version 2 0 january 2004": "apache-date",
    "you may not use this file except in compliance with the license": "apache-compliance",
    "you may obtain a copy of the license at": "apache-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-warranty",
    "see the license for the specific language governing permissions and limitations under the license": "apache-limits",
    "this work is licensed under the gnu general public license version 3": "gpl3-notice",
    "licensed under the gnu general public license version 3": "gpl3-notice",
    "gnu general public license": "gpl-title",
    "version 3 29 june 2007": "gpl3-date",
    "version 2 june 1991": "gpl2-date",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2-grant",
    # The standard headers have marks inside these sentences, at which the splitter ends them.
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl-terms",
    "either version 3 of the license or at your option any later version": "gpl3-later",
    "either version 2 of the license or at your option any later version": "gpl2-later",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-grant",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2-grant",
    "this program is distributed in the hope that it will be useful but without any warranty": "gpl-warranty-a",
    "without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-warranty-b",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-warranty",
    "see the gnu general public license for more details": "gpl-details",
    "licensed under cc by nc 4 0": "cc-by-nc-4-notice",
    "licensed under cc by 4 0": "cc-by-4-notice",
    "licensed under cc by sa 4 0": "cc-by-sa-4-notice",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4-notice",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa-4-notice",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc-4-notice",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-names",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl2-grant",
    "this source code form is subject to the terms of the mozilla public license v": "mpl2-grant-v",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "mpl2-copy",
    "if a copy of the mpl was not distributed with this file you can obtain one at http www mozilla org mpl 2 0": "mpl2-copy",
    "if a copy of the mpl was not distributed with this file you can obtain one at https www mozilla org mpl 2 0": "mpl2-copy",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "mpl2-copy",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "this is free and unencumbered software released into the public domain": "unlicense-grant",
    "all rights reserved": "reserved",
}

# Fixed values: (licence, identifiers in this order), the more telling rule first. Other known sentences may stand
# between them; a licence is reported once for each text.
RULES = [
    ("MIT", ["mit-grant", "mit-condition", "mit-warranty"]),
    ("MIT", ["mit-title", "mit-grant"]),
    ("MIT", ["mit-notice"]),
    ("Apache-2.0", ["apache-notice", "apache-compliance", "apache-warranty"]),
    ("Apache-2.0", ["apache-name", "apache-date"]),
    ("Apache-2.0", ["apache-title"]),
    ("Apache-2.0", ["apache-notice"]),
    ("GPL-3.0-or-later", ["gpl3-grant", "gpl-warranty"]),
    ("GPL-3.0-or-later", ["gpl3-grant", "gpl-warranty-a", "gpl-warranty-b"]),
    ("GPL-3.0-or-later", ["gpl-terms", "gpl3-later", "gpl-warranty"]),
    ("GPL-3.0-or-later", ["gpl-terms", "gpl3-later", "gpl-warranty-a", "gpl-warranty-b"]),
    ("GPL-3.0", ["gpl-title", "gpl3-date"]),
    ("GPL-3.0", ["gpl3-notice"]),
    ("GPL-2.0-or-later", ["gpl2-grant", "gpl-warranty"]),
    ("GPL-2.0-or-later", ["gpl2-grant", "gpl-warranty-a", "gpl-warranty-b"]),
    ("GPL-2.0-or-later", ["gpl-terms", "gpl2-later", "gpl-warranty"]),
    ("GPL-2.0-or-later", ["gpl-terms", "gpl2-later", "gpl-warranty-a", "gpl-warranty-b"]),
    ("GPL-2.0", ["gpl-title", "gpl2-date"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4-notice"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4-notice"]),
    ("CC-BY-4.0", ["cc-by-4-notice"]),
    ("MPL-2.0", ["mpl2-grant", "mpl2-copy"]),
    ("MPL-2.0", ["mpl2-grant-v", "mpl2-copy"]),
    ("ISC", ["isc-grant"]),
    ("Unlicense", ["unlicense-grant"]),
]

# The lesser and the Affero licence have notices like those of the general one. Words, name, versions.
FAMILIES = {"gpl": ("general", "GPL", ("2", "3")), "lgpl": ("lesser general", "LGPL", ("2 1", "3")), "agpl": ("affero general", "AGPL", ("3",))}
for _key, (_words, _name, _versions) in FAMILIES.items():
    _terms = f"you can redistribute it and or modify it under the terms of the gnu {_words} public license"
    _as = "as published by the free software foundation"
    SENTENCES |= {f"{_terms} {_as}": f"{_key}-terms", f"gnu {_words} public license": f"{_key}-title",
                  f"see the gnu {_words} public license for more details": f"{_key}-details"}
    for _v in _versions:
        _n, _later = _v.replace(" ", ""), f"either version {_v} of the license or at your option any later version"
        _spdx = f"{_name}-{_v.replace(' ', '.') if ' ' in _v else _v + '.0'}"
        SENTENCES |= {_later: f"gpl{_n}-later", f"{_terms} {_as} {_later}": f"{_key}{_n}-grant",
                      **{f"{_terms} {_as} version {_v} of the license{end}": f"{_key}{_n}-only" for end in ("", " only")},
                      **{f"{_terms} version {_v}{end} {_as}": f"{_key}{_n}-only" for end in ("", " only")},
                      f"version {_v} of the license": f"gpl{_n}-exactly"}
        RULES += [(f"{_spdx}-only", [f"{_key}{_n}-only"]), (f"{_spdx}-only", [f"{_key}-terms", f"gpl{_n}-exactly"])]
        if _key != "gpl":
            RULES += [(f"{_spdx}-or-later", [f"{_key}{_n}-grant"]), (f"{_spdx}-or-later", [f"{_key}-terms", f"gpl{_n}-later"])]
SENTENCES |= {k.replace("this program", "this library", 1): v for k, v in SENTENCES.items() if k.startswith("this program is distributed")}

# Names that may stand in a tag line.
TAGS = [
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0",
    "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0",
    "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0",
    "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "Zlib",
]
SENTENCES |= {"spdx " + re.sub(r"[^a-z0-9]+", " ", tag.lower()): f"spdx-{tag}" for tag in TAGS}
RULES += [(tag, [f"spdx-{tag}"]) for tag in TAGS]

#: A tag line is a sentence for each name in it; a plus behind a version means later ones too.
TAG_LINE = r"(?i)(?:SPDX-License-Identifier:|\G(?!^)[ \t]+(?:OR|AND)(?=[ \t]))[ \t]*[(]*([\w.-]*\w)(\+?)[)]*"

#: A copyright line stands by itself, also directly above a grant.
COPYRIGHT_LINE = r"(?mi)^[^\p{L}\p{N}\n]*(?:copyright[ \t]+(?:\([ \t]*c[ \t]*\)|©|\d{4})|(?:\([ \t]*c[ \t]*\)|©)[ \t]*\d{4}).*$"

#: The clause against endorsement names a holder of its own in many texts.
HOLDER = r"^neither the name of .* nor the names of its contributors"

#: A sentence ends at . ! ? ; or : before white space or the text's end, and at line ends. A line that does not end a
#: sentence may go on in the next line, so sentences of a paragraph are read both by lines and joined.
LINE_END = r"[.!?;:]+(?=\s|$)|\n"
BLOCK_END = r"[.!?;:]+(?=\s|$)|\n[ \t\r]*\n"

#: Comment marks at the start of a line. Without them a line of a mark alone is a blank line, and ';' ends no sentence.
MARKS = r"(?m)^[ \t]*(?:[#%*/;!'\"|<>-]+|(?i:rem|dnl)(?=[ \t\r]|$))[ \t]*"

#: A text without any of these words holds no known sentence; most texts go by.
MAY = r"licen[sc]e|permission|redistribut|warrant|liable|copyright|public domain|rights|version|mpl|spdx"


def normalised(sentence: Column) -> Column:
    """Lower-case words and numbers with one space between them; whoever a clause names is the copyright holder."""
    words = F.trim(F.regexp_replace(F.lower(sentence), r"[^\p{L}\p{N}]+", " "))
    return F.regexp_replace(words, HOLDER, "neither the name of the copyright holder nor the names of its contributors")


def prepared(text: Column) -> Column:
    """Text without comment marks, with copyright lines and the names of tag lines as paragraphs of their own."""
    bare = F.regexp_replace(F.regexp_replace(text, MARKS, ""), COPYRIGHT_LINE, "\n\n$0\n\n")
    return F.regexp_replace(F.regexp_replace(bare, TAG_LINE, "\n\nspdx $1$2\n\n"), r"(\n\nspdx [\w.-]+)\+", "$1-or-later")


def identifiers(text: Column, ends: str = BLOCK_END, sentences: dict[str, str] = SENTENCES) -> Column:
    """Identifiers of the known sentences of a text, in order of appearance.

    Only sentences of a fitting length that contain one of the table's first words are normalised: others can't be known.
    """
    known = F.create_map(*[F.lit(x) for kv in sentences.items() for x in kv])
    first = "|".join(sorted({re.escape(k.split(" ")[0]) for k in sentences}))
    lively = F.filter(F.split(F.coalesce(text, F.lit("")), ends), lambda s: s.rlike(rf"(?i)^[^\p{{L}}\p{{N}}]*(?:{first})(?![\p{{L}}\p{{N}}])"))
    return F.array_compact(F.transform(lively, lambda s: F.element_at(known, normalised(s))))


def matched(ids: Column, rules: list[tuple[str, list[str]]] = RULES) -> Column:
    """Licences of the rules whose identifiers occur in order, in the order of the rules, each once.

    A rule takes the identifiers it matches away, at every place where they occur in order; later rules see what is left.
    """
    listed = F.array(*[F.struct(
        F.lit(name).alias("name"), F.lit("(.*?)".join(f" {re.escape(x)}(?= )" for x in want)).alias("form"),
        F.lit("".join(f"${i}" for i in range(1, len(want)))).alias("rest")) for name, want in rules])

    def taken(state: Column, rule: Column) -> Column:
        hit = F.regexp_like(state["line"], rule["form"])
        return F.struct(F.when(hit, F.regexp_replace(state["line"], rule["form"], rule["rest"])).otherwise(state["line"]).alias("line"),
                        F.when(hit, F.array_append(state["found"], rule["name"])).otherwise(state["found"]).alias("found"))

    line = F.concat(F.lit(" "), F.concat_ws(" ", ids), F.lit(" "))
    nothing = F.array().cast("array<string>")
    applied = F.aggregate(listed, F.struct(line.alias("line"), nothing.alias("found")), taken, lambda state: F.array_distinct(state["found"]))
    return F.when(F.size(ids) > 0, applied).otherwise(nothing)


def licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, sentence_ids, licenses): one row per row of ``docs``, from the whole text.

    Sentences are read by blocks, for those that run over line ends, and by lines; those that only lines show come first in
    ``sentence_ids``, each once. Comment marks at line starts are no part of them. Null and empty texts have neither
    sentences nor licences. Equal rows give equal rows.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    may = F.lower("text").rlike(MAY)
    read = rows.select("doc_id", F.when(may, prepared(F.col("text"))).alias("text")).select(
        "doc_id", identifiers(F.col("text"), LINE_END).alias("lines"), identifiers(F.col("text"), BLOCK_END).alias("blocks"))
    ids = read.select("doc_id", F.concat(F.array_except("lines", "blocks"), "blocks").alias("sentence_ids"))
    return ids.select("doc_id", "sentence_ids", matched(F.col("sentence_ids")).alias("licenses"))
