"""License scans by sentence rules (DataFrame functions only)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licences and licence notices, each with an identifier.
SENTENCES = {
    "apache-notice": "Licensed under the Apache License, Version 2.0",
    "apache-notice-define": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License",
    "apache-obtain": "You may obtain a copy of the License at",
    "apache-unless": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "apache-see": "See the License for the specific language governing permissions and limitations under the License",
    "mit-notice": "Released under the MIT License",
    "mit-notice-licensed": "Licensed under the MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "gpl3-notice": "This work is licensed under the GNU General Public License, version 3",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "gpl-see": "See the GNU General Public License for more details",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-neither": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "isc-as-is": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS",
    "mit-0-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "bsl-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty",
    "zlib-liable": "In no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "mpl-subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v",
    "mpl-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    "gpl2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "lgpl21-free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    "lgpl3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "agpl3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "unlicense-domain": "This is free and unencumbered software released into the public domain",
    "unlicense-anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    "cddl-subject": "The contents of this file are subject to the terms of the Common Development and Distribution License",
    "epl2-terms": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "postgresql-grant": "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies",
    "cc-by-nc-4": "Licensed under CC BY-NC 4.0",
    "cc-by-4": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa-4": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
}
# Rules, most specific first; each is a licence and the identifiers that must follow one another.
RULES = (
    ("apache-2.0-header", "Apache-2.0", ("apache-notice-define", "apache-obtain", "apache-unless", "apache-see")),
    ("mit-text", "MIT", ("mit-grant", "mit-condition", "mit-as-is")),
    ("gpl-3.0-header", "GPL-3.0-or-later", ("gpl-free", "gpl-hope", "gpl-see")),
    ("bsd-2-clause-text", "BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("bsd-3-clause-text", "BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-neither")),
    ("isc-text", "ISC", ("isc-grant", "isc-as-is")),
    ("0bsd-text", "0BSD", ("0bsd-grant", "isc-as-is")),
    ("mit-0-text", "MIT-0", ("mit-0-grant", "mit-as-is")),
    ("bsl-1.0-text", "BSL-1.0", ("bsl-grant",)),
    ("zlib-text", "Zlib", ("zlib-as-is", "zlib-liable", "zlib-grant")),
    ("mpl-2.0-header", "MPL-2.0", ("mpl-subject", "mpl-copy")),
    ("gpl-2.0-header", "GPL-2.0-or-later", ("gpl2-free", "gpl-hope", "gpl-see")),
    ("lgpl-2.1-header", "LGPL-2.1-or-later", ("lgpl21-free",)),
    ("lgpl-3.0-header", "LGPL-3.0-or-later", ("lgpl3-free",)),
    ("agpl-3.0-header", "AGPL-3.0-or-later", ("agpl3-free",)),
    ("unlicense-text", "Unlicense", ("unlicense-domain", "unlicense-anyone")),
    ("cddl-header", "CDDL-1.0", ("cddl-subject",)),
    ("epl-2.0-header", "EPL-2.0", ("epl2-terms",)),
    ("postgresql-text", "PostgreSQL", ("postgresql-grant",)),
    ("apache-2.0-notice", "Apache-2.0", ("apache-notice",)),
    ("mit-notice", "MIT", ("mit-notice",)),
    ("mit-notice-licensed", "MIT", ("mit-notice-licensed",)),
    ("gpl-3.0-notice", "GPL-3.0-only", ("gpl3-notice",)),
    ("cc-by-nc-4.0-notice", "CC-BY-NC-4.0", ("cc-by-nc-4",)),
    ("cc-by-4.0-notice", "CC-BY-4.0", ("cc-by-4",)),
    ("cc-by-sa-4.0-notice", "CC-BY-SA-4.0", ("cc-by-sa-4",)),
)
# Licences by their identifiers, and what notices call them.
NAMES = {
    "Apache-2.0": ("Apache License 2.0", "Apache License, Version 2.0", "Apache 2.0 License"), "MIT": ("MIT License", "MIT license", "MIT"), "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"), "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License", "Modified BSD License"),
    "ISC": ("ISC License",), "0BSD": ("BSD Zero Clause License",), "MIT-0": ("MIT No Attribution License",), "Zlib": ("zlib License",), "BSL-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0"), "Unlicense": ("Unlicense",), "WTFPL": ("WTFPL",),
    "GPL-1.0-only": ("GNU General Public License, version 1",), "GPL-2.0-only": ("GNU General Public License, version 2", "GNU GPL v2", "GPLv2"), "GPL-3.0-only": ("GNU General Public License v3.0", "GNU GPL v3", "GPLv3"), "GPL-2.0-or-later": ("GNU General Public License, version 2 or later", "GPLv2 or later"), "GPL-3.0-or-later": ("GNU General Public License, version 3 or later", "GPLv3 or later"),
    "LGPL-2.1-only": ("GNU Lesser General Public License, version 2.1", "LGPLv2.1"), "LGPL-3.0-only": ("GNU Lesser General Public License, version 3", "LGPLv3"), "LGPL-2.1-or-later": ("GNU Lesser General Public License, version 2.1 or later",), "LGPL-3.0-or-later": ("GNU Lesser General Public License, version 3 or later",),
    "AGPL-3.0-only": ("GNU Affero General Public License, version 3", "AGPLv3"), "AGPL-3.0-or-later": ("GNU Affero General Public License, version 3 or later",), "MPL-1.1": ("Mozilla Public License 1.1",), "MPL-2.0": ("Mozilla Public License 2.0", "Mozilla Public License, version 2.0"), "EPL-1.0": ("Eclipse Public License 1.0",), "EPL-2.0": ("Eclipse Public License 2.0",),
    "CDDL-1.0": ("Common Development and Distribution License",), "EUPL-1.2": ("European Union Public Licence 1.2", "EUPL 1.2"), "Artistic-2.0": ("Artistic License 2.0",), "PSF-2.0": ("Python Software Foundation License",), "PostgreSQL": ("PostgreSQL License",), "OpenSSL": ("OpenSSL License",), "NCSA": ("University of Illinois/NCSA Open Source License",),
    "MS-PL": ("Microsoft Public License",), "MS-RL": ("Microsoft Reciprocal License",), "OFL-1.1": ("SIL Open Font License, Version 1.1", "SIL Open Font License 1.1"), "UPL-1.0": ("Universal Permissive License 1.0",), "ECL-2.0": ("Educational Community License, Version 2.0",), "AFL-3.0": ("Academic Free License 3.0",), "OSL-3.0": ("Open Software License 3.0",), "CPL-1.0": ("Common Public License 1.0",), "IPL-1.0": ("IBM Public License 1.0",),
    "Vim": ("Vim License",), "Ruby": ("Ruby License",), "PHP-3.01": ("PHP License 3.01",), "LPPL-1.3c": ("LaTeX Project Public License 1.3c",), "ODbL-1.0": ("Open Database License 1.0",), "PDDL-1.0": ("Public Domain Dedication and License 1.0",), "CECILL-2.1": ("CeCILL Free Software License Agreement 2.1",), "BlueOak-1.0.0": ("Blue Oak Model License 1.0.0",), "MulanPSL-2.0": ("Mulan Permissive Software License, Version 2",), "SSPL-1.0": ("Server Side Public License, version 1",), "BUSL-1.1": ("Business Source License 1.1",), "Elastic-2.0": ("Elastic License 2.0",),
    "CC0-1.0": ("Creative Commons Zero 1.0 Universal License", "CC0 1.0"), "CC-BY-3.0": ("Creative Commons Attribution 3.0 License", "CC BY 3.0"), "CC-BY-4.0": ("Creative Commons Attribution 4.0 License", "CC BY 4.0"), "CC-BY-SA-3.0": ("Creative Commons Attribution-ShareAlike 3.0 License", "CC BY-SA 3.0"), "CC-BY-SA-4.0": ("Creative Commons Attribution-ShareAlike 4.0 License", "CC BY-SA 4.0"),
    "CC-BY-NC-4.0": ("Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0"), "CC-BY-ND-4.0": ("Creative Commons Attribution-NoDerivatives 4.0 International License", "CC BY-ND 4.0"), "CC-BY-NC-SA-4.0": ("Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "CC BY-NC-SA 4.0"), "CC-BY-NC-ND-4.0": ("Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", "CC BY-NC-ND 4.0"),
}
# How notices begin.
BEGIN = ("Licensed under", "Released under", "Distributed under", "Available under", "This work is licensed under", "This project is licensed under", "This software is licensed under", "This file is licensed under", "This code is released under")
#: A sentence ends at a line's end, or at . ! ? ; or : before white space.
END = "[.!?;:]+[\\x20\\x09-\\x0D]+|[\\x0A-\\x0D]+"
#: A notice ends with the licence's name, or goes on with one of these words, such as "see LICENSE".
ON = ("see", "which", "as", "in", "that", "with", "for", "available", "found", "and is")
#: What stands before an expression of licences' identifiers: these, AND, OR, WITH an exception, brackets, and + for later versions.
SPDX = "spdx-license-identifier"
_LATER = "+"


def identifiers() -> dict[str, str]:
    """What stands in such expressions -> the licence: identifiers in small letters, with a plus where later versions are meant; and GNU ones as they were before "only"."""
    known = {key.lower(): key for key in NAMES}
    old = {key.lower().removesuffix("-only"): key for key in NAMES if key.endswith("-only")}
    plain = known | old
    return plain | {f"{k}{_LATER}": known.get(f"{k}-or-later", v) for k, v in plain.items()}


def normal(sentence: str) -> str:
    """Lower case, runs of anything but ASCII letters and digits are one space."""
    import re

    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


#: What stands before a notice's name of a licence in its place in the table of sentences; no normalised text holds it.
NOTICE = "@ "


def all_rules() -> tuple:
    """RULES, and one for each licence of NAMES: a notice of it, by any of its names."""
    return RULES + tuple((f"notice-of-{key.lower()}", key, (f"notice:{key}",)) for key in NAMES)


def known_sentences(sentences=None) -> list[tuple[str, str]]:
    """(normalised part, identifier) of each known sentence; one that END cuts gives parts id, id+1, id+2 and so on.

    Where no others are given, the names of licences too, after NOTICE in the place of how a notice begins. All of one licence have one identifier.
    """
    import re

    out = []
    for key, text in (sentences or SENTENCES).items():
        parts = [normal(p) for p in re.split(END, text) if normal(p)]
        out += [(p, key if k == 0 else f"{key}+{k}") for k, p in enumerate(parts)]
    if sentences is None:
        out += [(NOTICE + normal(name), f"notice:{key}") for key, names in NAMES.items() for name in names]
    # the same sentence under two names keeps the first
    return list({p: (p, i) for p, i in reversed(out)}.values())


def _rule_ids(ids, sentences=None) -> list[str]:
    known = dict(known_sentences(sentences))
    import re

    texts = sentences or SENTENCES
    return [i for key in ids for i in ([known[normal(p)] for p in re.split(END, texts[key]) if normal(p)] if key in texts else [key])]


def _begins(space: str) -> str:
    return "(?:" + "|".join(normal(b).replace(" ", space) for b in sorted(BEGIN, key=len, reverse=True)) + f")(?:{space}the{space}terms(?:{space}and{space}conditions)?{space}of)?(?:{space}the)?{space}"


def _any(texts) -> str:
    return "(?:" + "|".join(t.replace(" ", "[ B]") for t in sorted(texts, key=len, reverse=True)) + ")"


def _matcher(sentences=None) -> str:
    """Any known sentence between two breaks, the longest first; a line may end at each of its spaces. Breaks are as _flat writes them. Those that begin with the same two words share them."""
    heads: dict[str, list[str]] = {}
    parts = [p for p, _ in known_sentences(sentences)]
    for p in parts:
        if not p.startswith(NOTICE):
            words = p.split(" ")
            heads.setdefault("[ B]".join(words[:2]), []).append(" ".join(["", *words[2:]]))
    each = [h + _any(rest) for h, rest in heads.items()]
    whole = "(?:" + "|".join(each) + ")(?=[AB])"
    if names := [p[len(NOTICE) :] for p in parts if p.startswith(NOTICE)]:
        whole += "|" + _begins("[ B]") + _any(names) + "(?=[AB]| (?:" + "|".join(ON) + ")[ AB])"
    return "[AB](" + whole + ")"


def _marks(sentences=None, rules=RULES) -> list[str]:
    """A few words, long ones if it can be, of which the sentences of each rule hold one; lines don't end within words, so a text without any of them holds no rule's sentences."""
    texts = sentences or SENTENCES
    left, out = [{w for key in ids for w in normal(texts[key]).split()} for _, _, ids in rules], []
    while left:
        words = {w for ws in left for w in ws if len(w) >= 9 or w == max(sorted(ws), key=len)}
        out.append(max(sorted(words), key=lambda w: (sum(w in ws for ws in left), len(w))))
        left = [ws for ws in left if out[-1] not in ws]
    return out


#: What each notice and SPDX line holds, with line ends and comment leaders between.
_NOTICE_LIKE = "(?:" + "|".join(sorted({normal(b).split()[-2] for b in BEGIN})) + ")[^a-z0-9]+(?:(?:rem|dnl)[^a-z0-9]+)?under|" + SPDX


def _flat(text):
    """The text in small letters and digits. Between words stands A where a sentence must end (. ! ? ; or : before white space, or a blank line), B where a line ends, else a space.

    What is neither letter nor digit goes, and with it comment leaders; one that begins a line ends no sentence, whatever its signs, and a line of nothing else is blank.
    """
    low = F.regexp_replace(F.lower(text), "(?<=[\\x0A-\\x0D])[\\x20\\x09]*(?:@?rem|dnl)(?=[\\x20\\x09\\x0A-\\x0D])", "")
    # each run of other characters is tried once, from its beginning
    line, noise = "(?>\\x0D\\x0A|[\\x0A-\\x0D])", "[^a-z0-9\\x0A-\\x0D]*"
    hard = F.regexp_replace(low, f"(?<![^a-z0-9])(?:{noise}[.!?;:][\\x20\\x09-\\x0D]|{noise}+{line}{noise}+{line})[^a-z0-9]*+", "A")
    soft = F.regexp_replace(hard, f"(?<![^a-z0-9A])[^a-z0-9A\\x0A-\\x0D]*+{line}[^a-z0-9A]*+", "B")
    return F.concat(F.lit("A"), F.trim(F.regexp_replace(soft, "[^a-z0-9AB]+", " ")), F.lit("A"))


def scan_licenses(docs: DataFrame, sentences=None, rules=None) -> DataFrame:
    """-> doc_id, rule, license, n_found: a row per rule whose identifiers stand in order in the document.

    A known sentence is found where it begins and ends at a break (a line's end, or the end of a sentence); between its words lines may
    end, with comment leaders, so wrapped texts are found like unwrapped ones. Of known sentences that begin at one place the longest counts.
    What is not known leaves no identifier, so other lines may stand between the sentences of a rule. The identifiers
    of a row, in order, are matched against each rule; a rule that only repeats part of a longer one counts by itself.

    Lines with SPDX-License-Identifier count for the notice of each licence that their expression names, however it is joined with AND, OR and brackets; an exception after WITH is no licence, and a plus means the
    licence with later versions, where it has an identifier of its own.

    Null, empty and unlicensed texts give no row. Each row is matched by itself; the findings of rows that repeat a doc_id,
    or have none, add up. Other columns are ignored.
    """
    names = F.create_map(*[F.lit(x) for pair in known_sentences(sentences) for x in pair])
    table_of_rules = rules or (all_rules() if sentences is None else RULES)
    low = F.lower("text")
    marked = docs.where(reduce(Column.__or__, [F.contains(low, F.lit(w)) for w in _marks(sentences, rules or RULES)] + ([low.rlike(_NOTICE_LIKE)] if sentences is None else [])))
    marked = marked.select("doc_id", F.regexp_extract_all(_flat(F.col("text")), F.lit(_matcher(sentences)), F.lit(1)).alias("_found"), (_expressions("text") if sentences is None else F.array().cast("array<string>")).alias("_spdx"))
    plain = marked.where((F.size("_found") > 0) | (F.size("_spdx") > 0)).withColumn("_found", F.transform("_found", lambda x: F.replace(x, F.lit("B"), F.lit(" "))))
    run = F.transform("_found", lambda x: F.coalesce(names[x], names[F.regexp_replace(x, "^" + _begins(" "), NOTICE)]))
    # identifiers share their bars, so bars are doubled for counting
    runs = plain.select("doc_id", "_spdx", F.concat(F.lit("||"), F.array_join(run, "||"), F.lit("||")).alias("_run"))
    table = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(lic).alias("license"), F.lit("|" + "||".join(_rule_ids(ids, sentences)) + "|").alias("ids")) for n, lic, ids in table_of_rules])
    times = lambda ids: ((F.length("_run") - F.length(F.replace(F.col("_run"), ids, F.lit("")))) / F.length(ids)).cast("long")
    by_rule = F.filter(F.transform(table, lambda r: F.struct(r["rule"].alias("rule"), r["license"].alias("license"), times(r["ids"]).alias("n"))), lambda r: r["n"] > 0)
    by_name = F.transform("_spdx", lambda x: F.struct(F.concat(F.lit("notice-of-"), F.lower(x)).alias("rule"), x.alias("license"), F.lit(1).cast("long").alias("n")))
    each = runs.select("doc_id", F.explode(F.concat(by_rule, by_name)).alias("_r"))
    return each.groupBy("doc_id", F.col("_r.rule").alias("rule"), F.col("_r.license").alias("license")).agg(F.sum("_r.n").alias("n_found"))


def _expressions(text) -> Column:
    """The licences that the lines with identifiers name, one after the other: exceptions after WITH are none, words that are no identifier neither."""
    said = F.transform(F.regexp_extract_all(F.lower(text), F.lit(SPDX + ":([^\\x0A\\x0D]*)"), F.lit(1)), lambda x: F.regexp_replace(x, _EXCEPTION, " "))
    known = F.create_map(*[F.lit(x) for pair in identifiers().items() for x in pair])
    words = F.flatten(F.transform(said, lambda x: F.regexp_extract_all(x, F.lit(_WORD), F.lit(0))))
    return F.array_compact(F.transform(words, lambda w: known[w]))


_EXCEPTION, _WORD = "[\\x20\\x09(]with[\\x20\\x09]+[a-z0-9.-]+", "[a-z0-9]+(?:[.-][a-z0-9]+)*[+]?"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def oracle() -> str:
    known = ", ".join(f"({_q(p)}, {_q(i)})" for p, i in known_sentences())
    rules = ", ".join(f"({_q(n)}, {_q(lic)}, {_q('|' + '||'.join(_rule_ids(ids)) + '|')})" for n, lic, ids in all_rules())
    return f"""
WITH k(sentence, id) AS (VALUES {known}), r(rule, license, ids) AS (VALUES {rules}),
p AS (SELECT doc_id, string_split_regex(lower(text), '{END}') AS parts FROM documents),
l AS (SELECT doc_id, unnest(range(len(parts))) AS pos, unnest(parts) AS line FROM p),
m AS (SELECT doc_id, pos, trim(regexp_replace(line, '[^a-z0-9]+', ' ', 'g')) AS sentence FROM l),
g AS (SELECT *, regexp_replace(sentence, '^({_begins(" ")}.*?) (?:{"|".join(ON)})(?: .*)?$', '\\1') AS base FROM m),
i AS (SELECT doc_id, pos, coalesce(a.id, CASE WHEN b.id IS NOT NULL THEN c.id END, b.id) AS id FROM g LEFT JOIN k a ON a.sentence = g.sentence LEFT JOIN k b ON b.sentence = regexp_replace(base, '^{_begins(" ")}', '{NOTICE}') LEFT JOIN k c ON c.sentence = base),
f AS (SELECT doc_id, '||' || string_agg(id, '||' ORDER BY pos) || '||' AS run FROM i WHERE id IS NOT NULL GROUP BY doc_id),
s(word, license) AS (VALUES {", ".join(f"({_q(k)}, {_q(v)})" for k, v in identifiers().items())}),
e AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{SPDX}:([^\x0A\x0D]*)', 1)) AS said FROM documents),
w AS (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(said, '{_EXCEPTION}', ' ', 'g'), '{_WORD}')) AS word FROM e),
u AS (SELECT doc_id, rule, license, (length(run) - length(replace(run, ids, ''))) // length(ids) AS n FROM f, r WHERE contains(run, ids) UNION ALL SELECT doc_id, 'notice-of-' || lower(license), license, 1 FROM w JOIN s USING (word))
SELECT doc_id, rule, license, sum(n)::BIGINT AS n_found FROM u GROUP BY ALL
"""
