"""Licence scan by sentences and ordered rules, in DataFrame expressions only.

A text is normalised: ASCII letters in lower case, anything that is no letter or
digit as one space, comment marks at line starts dropped. A sentence ends at a mark
of its end or at a blank line; any other line break, also one with nothing but a
comment mark behind it, may be an end or lie inside a sentence. All stretches from
one such place to another are looked up, in one search, among the known
licence sentences, which gives the text's sequence of sentence identifiers. A rule
is an ordered list of identifiers; it holds if they occur in that order, others
may come between. A sentence that a rule doesn't allow must not lie among those it
asks for; elsewhere it belongs to another notice of the text. What licences the rules
name is the result.

Texts without any of ``ANCHORS`` are not cut up: every known sentence has one, so
nothing is lost by that.

Defined results: a null or empty text has no sentences and no licence; equal rows
get equal results; an empty table gives no rows.
"""

from __future__ import annotations

import re
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actionflow.llm.scratch import picked

# Sentences of public licence texts and of the notices they ask for.
SENTENCES = {
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-warranty": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "apache-licensed": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "apache-comply": "you may not use this file except in compliance with the License.",
    "apache-both": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "apache-unless": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "gpl3-grant": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2-grant": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-details": "See the GNU General Public License for more details.",
    "lgpl21-grant": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl3-grant": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl3-library": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-warranty": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "lgpl-details": "See the GNU Lesser General Public License for more details.",
    "agpl3-grant": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl-details": "See the GNU Affero General Public License for more details.",
    "mpl-subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-warranty": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "unlicense-domain": "This is free and unencumbered software released into the public domain.",
    "zlib-warranty": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "gpl2-title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "gpl3-title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "lgpl21-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "lgpl3-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "agpl3-title": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "apache2-title": "Apache License Version 2.0, January 2004",
    "mpl2-title": "Mozilla Public License Version 2.0",
    "boost-title": "Boost Software License - Version 1.0 - August 17th, 2003",
    "rights-reserved": "All rights reserved.",
}

# What licences are called, after their SPDX identifiers.
NAMED = {
    "MIT": ["MIT License", "MIT Licence"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0 License"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL v2", "GPLv2 License"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL v3", "GPLv3 License"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "GNU LGPL v2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU LGPL v3"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU AGPL v3"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License"],
    "ISC": ["ISC License"],
    "CC-BY-4.0": ["CC BY 4.0", "CC BY 4.0 License", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "CC BY-SA 4.0 License", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "CC BY-NC 4.0 License", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0", "CC BY-NC-SA 4.0 License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "CC BY-ND 4.0 License"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 License"],
    "Zlib": ["zlib License"],
    "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0"],
    "EPL-1.0": ["Eclipse Public License, Version 1.0", "Eclipse Public License 1.0"],
    "EPL-2.0": ["Eclipse Public License, Version 2.0", "Eclipse Public License 2.0"],
    "Artistic-2.0": ["Artistic License, Version 2.0", "Artistic License 2.0"],
    "CDDL-1.0": ["Common Development and Distribution License, Version 1.0", "Common Development and Distribution License 1.0"],
    "EUPL-1.2": ["European Union Public Licence, Version 1.2", "European Union Public Licence 1.2"],
    "Unlicense": ["Unlicense"],
    "0BSD": ["Zero-Clause BSD License", "BSD Zero Clause License"],
}
SAID = ["Licensed under", "Released under", "This work is licensed under", "This software is licensed under", "This project is licensed under", "Distributed under", "Available under license"]

# Fixed values: (licence, sentences in this order, sentences that must not occur among them).
RULES = [
    ("MIT", ["mit-grant", "mit-notice", "mit-warranty", "mit-liability"], []),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-warranty"], []),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty"], ["bsd-endorse"]),
    ("Apache-2.0", ["apache-licensed", "apache-comply"], []),
    ("Apache-2.0", ["apache-both"], []),
    ("GPL-3.0", ["gpl3-grant", "gpl-warranty"], []),
    ("GPL-2.0", ["gpl2-grant", "gpl-warranty"], []),
    ("LGPL-2.1", ["lgpl21-grant", "lgpl-warranty"], []),
    ("LGPL-3.0", ["lgpl3-grant", "gpl-warranty"], []),
    ("LGPL-3.0", ["lgpl3-library", "lgpl-warranty"], []),
    ("AGPL-3.0", ["agpl3-grant", "gpl-warranty"], []),
    ("MPL-2.0", ["mpl-subject"], []),
    ("ISC", ["isc-grant", "isc-warranty"], []),
    ("Zlib", ["zlib-warranty", "zlib-grant"], []),
    ("GPL-2.0", ["gpl2-title"], []),
    ("GPL-3.0", ["gpl3-title"], []),
    ("LGPL-2.1", ["lgpl21-title"], []),
    ("LGPL-3.0", ["lgpl3-title"], []),
    ("AGPL-3.0", ["agpl3-title"], []),
    ("Apache-2.0", ["apache2-title"], []),
    ("MPL-2.0", ["mpl2-title"], []),
    ("BSL-1.0", ["boost-title"], []),
    ("Unlicense", ["unlicense-domain"], []),
    *[(name, [f"named-{name}"], []) for name in NAMED],
]

ANCHORS = ("licen", "copyright", "permission", "warrant", "redistribut", "unencumbered", "released", "distributed", "reserved")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ANCHOR_PATTERN = "|".join("".join(f"[{c.upper()}{c}]" for c in a) for a in ANCHORS)


def normal(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.translate(str.maketrans(UPPER, LOWER))).strip()


def known_sentences() -> dict[str, str]:
    """Normalised sentence -> identifier: the listed ones, and every way of saying each name."""
    said = {normal(f"{a} {the}{name}"): f"named-{k}" for k, names in NAMED.items() for name in names for a in SAID for the in ("", "the ")}
    tags = {normal(f"SPDX-License-Identifier: {k}{end}"): f"named-{k}" for k in NAMED for end in ("", "-only", "-or-later")}
    found = said | tags | {normal(s): k for k, s in SENTENCES.items()}
    assert all(any(a in s for a in ANCHORS) for s in found), "a known sentence without an anchor would be passed over"
    return found


def known_pattern() -> str:
    """All known sentences as one pattern over ``marked`` texts; at one place the shortest goes first."""
    tree: dict = {}
    for sentence in known_sentences():
        node = tree
        for word in sentence.split(" "):
            node = node.setdefault(word, {})
        node[""] = {}

    def after(node: dict) -> str:
        ways = ["(?=[SH])"] * ("" in node) + [f"[ S]{w}{after(n)}" for w, n in node.items() if w]
        return ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})"

    return f"(?<=[SH])(?:{'|'.join(w + after(n) for w, n in tree.items())})"


def marked(text: Column) -> Column:
    """The normalised text with H where a sentence must end and S where it may."""
    t = F.concat(F.lit("\n"), F.translate(text, UPPER, LOWER), F.lit("\n"))
    for pattern, by in (("\\n[ \\t\\r]*(?=\\n)", "H"), ("\\n[^a-z0-9H\\n]*", "S"), ("[.!?](?=[ \\t\\rSH])", "H"), ("[^a-z0-9SH]+", " "), (" ?S[ S]*", "S"), ("[ S]?H[ SH]*", "H")):
        t = F.regexp_replace(t, pattern, by)
    return t


def sentence_ids(text: Column) -> Column:
    """The identifiers of a text's known sentences in order, whether each is on a line of its own or wrapped."""
    known = F.create_map(*chain.from_iterable((F.lit(s), F.lit(i)) for s, i in known_sentences().items()))
    met = F.regexp_extract_all(marked(text), F.lit(known_pattern()), F.lit(0))
    found = F.transform(met, lambda s: F.element_at(known, F.translate(s, "S", " ")))
    return F.coalesce(F.when(text.rlike(ANCHOR_PATTERN), found), F.array().cast("array<string>"))


def licences(ids: Column) -> Column:
    """The licences whose rules hold for a sequence of identifiers, sorted."""
    line = F.concat(F.lit(" "), F.array_join(ids, "  "), F.lit(" "))
    holds = []
    for name, wanted, unwanted in RULES:
        pattern = "% " + " % ".join(wanted) + " %"
        rule = F.exists(F.split(line, "|".join(f" {u} " for u in unwanted)), lambda part: part.like(pattern)) if unwanted else line.like(pattern)  # noqa: B023
        holds.append(F.when(rule, F.lit(name)))
    return F.when(F.size(ids) > 0, F.array_sort(F.array_distinct(F.array_compact(F.array(*holds))))).otherwise(F.array().cast("array<string>"))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, sentence_ids and licenses (arrays) of every document."""
    ids = picked(docs, doc_id=doc_id, text=text).select("doc_id", sentence_ids(F.col("text")).alias("sentence_ids"))
    return ids.withColumn("licenses", licences(F.col("sentence_ids")))
