from tidemark.llm.licenses import BEGIN, NAMES, RULES, SENTENCES, scan_licenses

from .data import frame, odd_rows


def scan(spark, rows):
    return {(r.doc_id, r.rule): r.n_found for r in scan_licenses(frame(spark, rows, clashing=True)).collect()}


def test_rules(spark):
    mit = "Copyright (c) 2020 Somebody\n\n" + ". ".join(SENTENCES[k].rstrip(":") for k in ("mit-grant", "mit-condition", "mit-as-is")) + "."
    header = "# " + ".\n# ".join(SENTENCES[k] for k in ("apache-notice-define", "apache-obtain")) + "\n#\n#   http://www.apache.org/licenses/LICENSE-2.0\n#\n# " + ".\n# ".join(SENTENCES[k] for k in ("apache-unless", "apache-see")) + "."
    rows = [
        (1, "Text.\nLicensed under the Apache License, Version 2.0.", "s"),
        (2, "Released under   the MIT license!! More. Released under the MIT License", "s"),
        (3, mit.replace(": ", ":\n"), "s"),
        (4, "THIS WORK IS LICENSED UNDER THE GNU GENERAL PUBLIC LICENSE, VERSION 3.", "s"),
        (5, "licensed under something else", "s"),
        (6, header, "s"),
        (7, ". ".join(SENTENCES[k] for k in ("bsd-source", "bsd-grant")), "s"),
        *[(i + 100 if i is not None else i, t, s) for i, t, s in odd_rows()],
        (None, "Licensed under CC BY-NC 4.0.", None),
    ]
    assert scan(spark, rows) == {(1, "apache-2.0-notice"): 1, (2, "mit-notice"): 2, (3, "mit-text"): 1, (4, "gpl-3.0-notice"): 1, (6, "apache-2.0-header"): 1, (None, "cc-by-nc-4.0-notice"): 1}


def test_empty(spark):
    assert scan_licenses(frame(spark, [])).count() == 0


def test_wrapped(spark):
    import textwrap

    joined = lambda *keys: ". ".join(SENTENCES[k].rstrip(":") for k in keys) + "."
    texts = {
        "apache-2.0-header": SENTENCES["apache-notice-define"] + ". " + SENTENCES["apache-obtain"] + "\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\n" + joined("apache-unless", "apache-see"),
        "mit-text": "Copyright (c) 2020 Somebody\n\n" + joined("mit-grant", "mit-condition", "mit-as-is") + " IN NO EVENT SHALL",
        "gpl-3.0-header": joined("gpl-free", "gpl-hope", "gpl-see"),
        "bsd-2-clause-text": SENTENCES["bsd-grant"] + "\n\n 1. " + SENTENCES["bsd-source"] + ".\n 2. " + SENTENCES["bsd-binary"] + ".",
    }
    rows, want = [], {}
    for rule, text in texts.items():
        for leader, width, end in (("", 72, "\n"), ("# ", 72, "\n"), (" * ", 60, "\r\n"), ("// ", 40, "\n"), (";; ", 72, "\n"), ("dnl ", 72, "\n"), ("", 30, "\r")):
            lines = [x for part in text.split("\n") for x in textwrap.wrap(part, width) or [""]]
            rows.append((len(rows), end.join([leader + "first line", leader, *[leader + x for x in lines]]), "s"))
            want[len(rows) - 1, rule] = 1
    # a notice on a line of its own needs no full stop; a blank line ends a sentence; the longest of two counts
    rows += [(100, "Some words\nReleased under the MIT License\nmore words", "s"), (101, "Released under\n\nthe MIT License", "s"), (102, SENTENCES["apache-notice-define"].replace(" (the", "\n# (the"), "s")]
    want[100, "mit-notice"] = 1
    assert scan(spark, rows) == want


def test_notices(spark):
    """Every licence by each of its names, in a few of the ways in which notices begin, and by its identifier."""
    rows, want = [], {}
    for k, (key, names) in enumerate(NAMES.items()):
        lines = [f"{BEGIN[(k + j) % len(BEGIN)]}{' the' if j % 2 else ''} {name}" for j, name in enumerate(names)]
        rows += [(2 * k, "Words. " + ".\n".join(lines) + ".", "s"), (2 * k + 1, f"# SPDX-License-Identifier: {key}\n", "s")]
        want[2 * k, key] = len(names)
        want[2 * k + 1, key] = 1
    found = {}
    for r in scan_licenses(frame(spark, rows)).collect():
        found[r.doc_id, r.license] = found.get((r.doc_id, r.license), 0) + r.n_found
    assert found == want and len(NAMES) > 60
    assert scan(spark, [(1, "Released under the MIT licence of ours\n", "s"), (2, "notice mit license. @ mit license", "s"), (3, "Released under the Vim License and more", "s")]) == {}


def test_more_texts(spark):
    joined = lambda *keys: "\n\n".join(SENTENCES[k] + "." for k in keys)
    rules = {r: ids for r, _, ids in RULES if r in ("bsd-3-clause-text", "isc-text", "mit-0-text", "zlib-text", "mpl-2.0-header", "gpl-2.0-header", "lgpl-2.1-header", "lgpl-3.0-header", "agpl-3.0-header", "unlicense-text", "bsl-1.0-text", "postgresql-text")}
    rows = [(k, joined(*ids).replace(":.", ":"), "s") for k, ids in enumerate(rules.values())]
    got = scan(spark, rows)
    assert all(got.get((k, rule)) == 1 for k, rule in enumerate(rules)) and len(rules) == 12


def test_rows_by_themselves(spark):
    keys = ("mit-grant", "mit-condition", "mit-as-is")
    mit = "Words. " * 3 + ". ".join(SENTENCES[k].rstrip(":") for k in keys) + "."
    rows = [(None, mit, "s"), (None, mit, "s"), (1, mit, "s"), (1, mit, "s"), (2, SENTENCES["mit-grant"], "s"), (2, "x. " + ". ".join(SENTENCES[k] for k in keys[1:]), "s")]
    assert scan(spark, rows) == {(None, "mit-text"): 2, (1, "mit-text"): 2}


def test_expressions(spark):
    """Identifiers in expressions; notices by their terms, and notices that go on."""
    lines = {
        "MIT OR Apache-2.0": {"MIT", "Apache-2.0"}, "(MIT AND BSD-3-Clause)": {"MIT", "BSD-3-Clause"}, "GPL-2.0-only WITH Classpath-exception-2.0": {"GPL-2.0-only"}, "((GPL-2.0+ WITH MIT) OR mit) AND ISC */": {"GPL-2.0-or-later", "MIT", "ISC"},
        "Apache-2.0+": {"Apache-2.0"}, "GPL-3.0": {"GPL-3.0-only"}, "MIT.": {"MIT"}, "LicenseRef-Own OR nothing": set(), "": set(),
    }
    rows = [(k, f"// SPDX-License-Identifier: {line}\nint x; // MIT, ISC", "s") for k, line in enumerate(lines)]
    rows += [(50, "Licensed under the MIT License, see LICENSE.", "s"), (51, "It is so. Licensed under the terms of the MIT license.", "s"), (52, "Released under the terms and conditions of the ISC License which is in COPYING", "s"), (53, "Released under the MIT License and more", "s")]
    got = {}
    for r in scan_licenses(frame(spark, rows)).collect():
        got.setdefault(r.doc_id, set()).add(r.license)
        assert r.n_found == 1
    assert got == {**{k: v for k, v in enumerate(lines.values()) if v}, 50: {"MIT"}, 51: {"MIT"}, 52: {"ISC"}}


def test_sql_has_the_same_rules(spark):
    """Documents of notices, expressions and texts, each sentence on a line of its own, by the SQL too."""
    import random

    import duckdb
    import pandas as pd

    from tidemark.llm.licenses import oracle

    rng, docs = random.Random(7), []
    pieces = list(SENTENCES.values()) + [f"{b} {name}" for b in BEGIN for names in NAMES.values() for name in names] + [f"# SPDX-License-Identifier: {a} {j} {b}" for a in NAMES for j, b in (("OR", "MIT"), ("WITH", "ISC"), ("AND", "(GPL-2.0+ OR 0BSD)"))]
    pieces += ["words of no licence", "Licensed under the MIT License, see LICENSE", "Released under the terms of the ISC License"]
    for i in range(300):
        docs.append((i, "\n".join(rng.choice(pieces) + "." for _ in range(rng.randrange(8))), "s"))
    documents = pd.DataFrame([(i, t) for i, t, _ in docs], columns=["doc_id", "text"])
    con = duckdb.connect()
    con.register("documents", documents)
    want = sorted(con.execute(f"SELECT doc_id, rule, license, n_found FROM ({oracle()})").fetchall())
    assert sorted(map(tuple, scan_licenses(frame(spark, docs)).select("doc_id", "rule", "license", "n_found").collect())) == want and len(want) > 500
