import re

from actionflow.llm import license_scan as ls

MIT = [ls.SENTENCES[k] for k in ("mit-grant", "mit-notice", "mit-warranty", "mit-liability")]


def wrap(text, width=70, mark=""):
    lines, line = [], ""
    for w in text.split(" "):
        if len(line) + len(w) > width:
            lines.append(mark + line.strip())
            line = ""
        line += w + " "
    return "\n".join([*lines, mark + line.strip()])


CASES = [
    (None, []), ("", []), ("no words of that kind", []), ("Released under the MIT License.", ["MIT"]),
    ("some line without an end\nLicensed under CC BY-NC 4.0.\nmore", ["CC-BY-NC-4.0"]),
    ("Intro. This work is licensed under the GNU General Public License, version 3. Then more.", ["GPL-3.0"]),
    ("LICENSED UNDER THE APACHE LICENSE, VERSION 2.0!", ["Apache-2.0"]),
    ("# SPDX-License-Identifier: GPL-2.0-or-later\ncode", ["GPL-2.0"]),
    ("\n\n".join(wrap(s) for s in MIT), ["MIT"]), ("\n".join(wrap(s, 60, " * ") for s in MIT), ["MIT"]), ("\n\n".join(wrap(s) for s in reversed(MIT)), []), ("\n\n".join(MIT[:3]), []),
    ("\n".join(f"{i}. {ls.SENTENCES[k]}" for i, k in enumerate(["bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty"])), ["BSD-2-Clause"]),
    ("\n".join(f"{i}. {ls.SENTENCES[k]}" for i, k in enumerate(["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-warranty"])), ["BSD-3-Clause"]),
    (wrap(ls.SENTENCES["apache-both"], 60), ["Apache-2.0"]), ("We released under the table. The MIT License is nice.", []),
    ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007", ["GPL-3.0"]), ("Mozilla Public License Version 2.0\n==================================\n\n1. Definitions", ["MPL-2.0"]),
    ("Licensed under the Boost Software License, Version 1.0.", ["BSL-1.0"]), ("\n\n".join(wrap(ls.SENTENCES[k]) for k in ("zlib-warranty", "zlib-grant")), ["Zlib"]), ("license" + " " * 200_000 + "x", []), ("license \n" * 50_000, []),
    ("word. " * 50_000 + "Released under the MIT License. Licensed under CC0 1.0.", ["CC0-1.0", "MIT"]),
]


def brute(text):
    """By plain Python: cut, look up, match in order."""
    t = text or ""
    known = ls.known_sentences()
    joined = re.sub(r"[ \t\r]*\n[^a-zA-Z0-9\n]*", " ", re.sub(r"\n[ \t\r]*\n", ". ", re.sub(r":[ \t\r]*\n", ":. ", t)))
    ways = [[known[n] for s in re.sub(r"([.!?])[ \t\r]+", "\\1\n", c).split("\n") if (n := ls.normal(s)) in known] for c in (t, joined)]
    ids = max(ways, key=len)
    out = set()
    for name, wanted, unwanted in ls.RULES:
        rest = iter(ids)
        if all(w in rest for w in wanted) and not set(unwanted) & set(ids):
            out.add(name)
    return ids, sorted(out)


def test_cases(spark):
    rows = [(i, t, "x") for i, (t, _) in enumerate(CASES)]
    rows.append(rows[3])
    df = spark.createDataFrame(rows, "doc_id int, text string, licenses string")
    got = ls.scan(df).collect()
    assert len(got) == len(rows)
    for r in got:
        text, want = CASES[r.doc_id]
        assert r.licenses == want, text[:80]
        assert (r.sentence_ids, r.licenses) == brute(text)
    assert ls.scan(df.limit(0)).collect() == []


GPL3 = [ls.SENTENCES[k] for k in ("gpl3-grant", "gpl-warranty")]


def test_comment_headers(spark):
    """Blank comment lines and unpunctuated lines above a wrapped notice; each kind of comment mark."""
    bodies = ["\n".join(wrap(s, 60, m) for s in GPL3) for m in (" * ", "# ", "// ", "! ", "")]
    texts = [
        "/* Copyright (C) 2020 Foo\n *\n" + bodies[0] + "\n */", "# SPDX line follows\n#\n" + bodies[1], "// MIT-ish Title\n" + bodies[2], "! Fortran\n!\n" + bodies[3], "Title\n" + bodies[4],
        bodies[0].replace("free software: ", "free software:\n * ").replace("\n", "\n *\n"), "Copyright Foo\r\n" + bodies[4].replace("\n", "\r\n"),
        'Licensed under the Apache License,\nVersion 2.0 (the "License");\nyou may not use this file except in compliance with the License.',
    ]
    got = {r.doc_id: r for r in ls.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()}
    for i, text in enumerate(texts[:-1]):
        assert (got[i].sentence_ids, got[i].licenses) == (["gpl3-grant", "gpl-warranty"], ["GPL-3.0"]), text
    assert got[len(texts) - 1].licenses == ["Apache-2.0"]


def test_mixed_forms(spark):
    """Licences on lines of their own and wrapped ones in one text."""
    two, three = (["bsd-grant", "bsd-source", "bsd-binary", *e, "bsd-warranty"] for e in ([], ["bsd-endorse"]))
    lines, wrapped = (lambda ids: "\n".join(ls.SENTENCES[k] for k in ids)), (lambda ids: "\n\n".join(wrap(ls.SENTENCES[k]) for k in ids))
    cases = [
        ("SPDX-License-Identifier: MIT\nReleased under the ISC License\nLicensed under CC BY 4.0\n\n" + "\n".join(wrap(s) for s in GPL3), ["named-MIT", "named-ISC", "named-CC-BY-4.0", "gpl3-grant", "gpl-warranty"], ["CC-BY-4.0", "GPL-3.0", "ISC", "MIT"]),
        (wrapped(["gpl3-grant", "gpl-warranty"]) + "\nReleased under the ISC License\n" + wrapped(["mpl-subject"]), ["gpl3-grant", "gpl-warranty", "named-ISC", "mpl-subject"], ["GPL-3.0", "ISC", "MPL-2.0"]),
        (lines(two) + "\n\n" + wrapped(three), two + three, ["BSD-2-Clause", "BSD-3-Clause"]),
        (wrapped(three) + "\n\n" + lines(two), three + two, ["BSD-2-Clause", "BSD-3-Clause"]),
        (lines(three) + "\n\n" + wrapped(three), three + three, ["BSD-3-Clause"]),
    ]
    got = {r.doc_id: r for r in ls.scan(spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "doc_id int, text string")).collect()}
    for i, (_, ids, names) in enumerate(cases):
        assert (got[i].sentence_ids, got[i].licenses) == (ids, names)


def test_lesser_and_affero_notices(spark):
    """Standard file notices; a rights line has an identifier and is no licence."""
    notices = [("lgpl21-grant", "lgpl-warranty", "lgpl-details", "LGPL-2.1"), ("lgpl3-grant", "gpl-warranty", "lgpl-details", "LGPL-3.0"), ("lgpl3-library", "lgpl-warranty", "lgpl-details", "LGPL-3.0"), ("agpl3-grant", "gpl-warranty", "agpl-details", "AGPL-3.0")]
    rows = [("/*\n" + "\n *\n".join(wrap(ls.SENTENCES[k], 65, " * ") for k in n[:3]) + "\n */", list(n[:3]), [n[3]]) for n in notices]
    rows.append(("Foo 2020. All rights reserved.\nprose", ["rights-reserved"], []))
    got = {r.doc_id: r for r in ls.scan(spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "doc_id int, text string")).collect()}
    for i, (_, ids, names) in enumerate(rows):
        assert (got[i].sentence_ids, got[i].licenses) == (ids, names)


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id int, text string")
    assert "Python" not in ls.scan(df)._jdf.queryExecution().toString()
