"""Licence scan: whole texts under edits that do not matter, lines, and edge cases."""

import textwrap

from factorloom.llm import licenses

DOCS = "doc_id long, text string, license_id string"


def found(frame, *texts):
    out = licenses.scan(frame([(i, t, "own") for i, t in enumerate(texts)], DOCS), "text").collect()
    return {r["doc_id"]: (r["license_id_"], r["notice_ids"], r["n_notices"]) for r in out}


def test_whole_texts_match_in_any_dress(frame):
    for name, text in licenses.TEXTS.items():
        wrapped = "/*\n" + "\n".join(" * " + x for x in textwrap.wrap(text, 60)) + "\n */"
        british = text.replace("License", "Licence").replace("sublicense", "sub-licence").replace("acknowledgment", "acknowledgement")
        got = found(frame, text, text.upper(), f"Copyright (c) 2020-2021 Some One\n\n{text}", wrapped, british, text + "\nextra words", text[:-40])
        assert [got[i][0] for i in range(7)] == [name] * 5 + [None] * 2, name


def test_lines_and_edges(frame):
    long = "word " * 50_000 + "\nReleased under the MIT Licence!\nReleased under the MIT License."
    got = found(frame, None, "", "no such thing", "Licensed under CC BY-NC 4.0.", long)
    assert got[0] == got[1] == got[2] == (None, [], 0)
    assert got[3] == ("CC-BY-NC-4.0", ["CC-BY-NC-4.0"], 1)
    assert got[4] == (None, ["MIT"], 2)
    assert licenses.scan(frame([], DOCS), "text").collect() == []


def test_every_known_text_has_an_anchor():
    for text in [*licenses.TEXTS.values(), *licenses.NOTICES]:
        assert any(a in text.lower() for a in licenses.ANCHORS)


def test_whole_texts_match_at_every_width(frame):
    for name in ("MIT", "BSD-2-Clause"):
        got = found(frame, *["\n".join(textwrap.wrap(licenses.TEXTS[name], w)) for w in range(40, 121)])
        assert [got[i][0] for i in range(81)] == [name] * 81, name


def test_longer_families(frame):
    texts = {**licenses.LONG_TEXTS, "BSD-3-Clause": licenses.BSD3}
    assert {"Apache-2.0", "GPL-2.0-only", "GPL-3.0-only", "LGPL-2.1-only", "LGPL-3.0-only", "MPL-2.0"} <= texts.keys()
    got = found(frame, *texts.values(), *["/*\n" + "\n".join(" * " + y for y in x.splitlines()) + "\n */" for x in texts.values()])
    assert [got[i][0] for i in range(2 * len(texts))] == [*texts, *texts]
    apache = licenses.LONG_TEXTS["Apache-2.0"]
    got = found(frame, apache.replace("[yyyy] [name of copyright owner]", "2021 Some One"), apache.split("APPENDIX")[0], apache[:-300])
    assert [got[i][0] for i in range(3)] == ["Apache-2.0", "Apache-2.0", None]


def test_own_known_text_without_an_anchor(frame):
    known = frame([("PD", "text", "Dedicated to the public domain."), ("CC", "notice", "No rights reserved"), ("X", "text", "")], "known_id string, kind string, body string")
    docs = frame([(0, "dedicated to the\nPublic Domain", "own"), (1, "some text\nNo rights reserved.", "own"), (2, "", "own"), (3, None, "own")], DOCS)
    got = {r["doc_id"]: (r["license_id_"], r["notice_ids"]) for r in licenses.scan(docs, "text", known).collect()}
    assert got == {0: ("PD", []), 1: (None, ["CC"]), 2: (None, []), 3: (None, [])}


def test_forms_in_the_wild(frame):
    """Titles in any words or none, copyright lines of any form, mark-up, and own names in clause three."""
    got = found(frame, *[x for _, x in licenses.probes()])
    n = len(licenses.plain_texts())
    assert [got[i][0] for i in range(n)] == [k for k, _ in licenses.plain_texts()]
    assert [got[i][0] for i in range(n, len(got))] == ["MIT"] * 4 + ["BSD-2-Clause"] * 2 + ["MIT", "BSD-3-Clause", None, None]
    body = licenses.MIT.partition("\n\n")[2]
    titles = ["MIT License", "The MIT License", "MIT", "# MIT License (MIT)", "The Expat License", "", "Apache License", "My own terms"]
    got = found(frame, *[f"{t}\n\nCopyright 1999-2003, 2010 by Ann Lee and others\n{body}" for t in titles])
    assert [got[i][0] for i in range(len(titles))] == ["MIT"] * 6 + [None] * 2
