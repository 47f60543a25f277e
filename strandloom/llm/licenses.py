"""Licence scan by sentence rules, with DataFrame operations only.

Lines lose their comment markers. A line feed is a space after a line of ``WRAP``
characters or more, as wrapped text has them, and before a line that begins with a
small letter, but not after a tag; else it ends a sentence, as . ! ? do before white space, unless a single
letter stands before (v. 2.0), and as a colon does that opens conditions. A sentence's
normal form is its lower-case letters and digits with single spaces. Normal forms map
to identifiers of known licence sentences, and the sequence of identifiers in a text
is matched against rules: a licence's identifiers in their order, with at most ``GAP``
other known sentences between two of them. Rules go in order, longer ones first, and a
rule takes the sentences that it matches, so a shorter one can't have them too. All of
it is a projection: no shuffle, whatever the table's size.
"""

from __future__ import annotations

import re

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GAP, WRAP = 2, 50

# Public licence texts, sentence by sentence. ... stands for a name.
#: Identifier -> sentence.
SENTENCES = {
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-0-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "x11-names": "Except as contained in this notice, the name of the ... shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization from the ....",
    "apache-grant": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-warranty": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "gpl3-grant": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2-grant": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl2-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "lgpl21-grant": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl3-grant": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl3-grant": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "lgpl-warranty": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-ads": "All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by ....",
    "bsd-names": "Neither the name of ... nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-warranty": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "isc-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "mpl2-grant": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl11-grant": "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License.",
    "mpl11-form": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1.",
    "unlicense-grant": "This is free and unencumbered software released into the public domain.",
    "unlicense-any": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "bsl-grant": "Distributed under the Boost Software License, Version 1.0.",
    "wtfpl-grant": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
    "epl2-grant": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "cc0-waiver": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
}

#: Rules in order: (licence, identifiers). Of two that could match the same sentences, the longer is first.
RULES = [
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-ads", "bsd-names")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD-1-Clause", ("bsd-grant", "bsd-source", "bsd-warranty")),
    ("X11", ("mit-grant", "mit-notice", "mit-warranty", "x11-names")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT-0", ("mit-0-grant",)),
    ("Apache-2.0", ("apache-grant",)),
    ("GPL-3.0", ("gpl3-grant",)),
    ("GPL-2.0", ("gpl2-grant",)),
    ("GPL-2.0", ("gpl2-only",)),
    ("LGPL-2.1", ("lgpl21-grant",)),
    ("LGPL-3.0", ("lgpl3-grant",)),
    ("AGPL-3.0", ("agpl3-grant",)),
    ("ISC", ("isc-grant",)),
    ("0BSD", ("0bsd-grant",)),
    ("MPL-2.0", ("mpl2-grant",)),
    ("MPL-1.1", ("mpl11-grant",)),
    ("MPL-1.1", ("mpl11-form",)),
    ("Unlicense", ("unlicense-grant",)),
    ("Zlib", ("zlib-grant",)),
    ("BSL-1.0", ("bsl-grant",)),
    ("WTFPL", ("wtfpl-grant",)),
    ("EPL-2.0", ("epl2-grant",)),
    ("CC0-1.0", ("cc0-waiver",)),
]

#: Licence -> names by which short notices call it.
NAMES = {
    "MIT": ("the MIT License", "MIT License", "the MIT Licence", "MIT"),
    "Apache-2.0": ("the Apache License, Version 2.0", "the Apache License 2.0", "the Apache 2.0 License", "Apache License 2.0", "Apache 2.0"),
    "GPL-2.0": ("the GNU General Public License, version 2", "the GNU General Public License v2.0", "the GPL version 2", "GPLv2"),
    "GPL-3.0": ("the GNU General Public License, version 3", "the GNU General Public License v3.0", "the GPL version 3", "GPLv3"),
    "LGPL-2.1": ("the GNU Lesser General Public License, version 2.1", "LGPLv2.1"),
    "LGPL-3.0": ("the GNU Lesser General Public License, version 3", "LGPLv3"),
    "AGPL-3.0": ("the GNU Affero General Public License, version 3", "AGPLv3"),
    "BSD-2-Clause": ("the BSD 2-Clause License", "the 2-clause BSD License", "the Simplified BSD License"),
    "BSD-3-Clause": ("the BSD 3-Clause License", "the 3-clause BSD License", "the New BSD License"),
    "ISC": ("the ISC License",),
    "MPL-1.1": ("the Mozilla Public License 1.1", "MPL 1.1"),
    "MPL-2.0": ("the Mozilla Public License 2.0", "the Mozilla Public License, version 2.0", "MPL 2.0"),
    "EPL-2.0": ("the Eclipse Public License 2.0", "EPL 2.0"),
    "Unlicense": ("the Unlicense",),
    "Zlib": ("the zlib License",),
    "BSL-1.0": ("the Boost Software License 1.0",),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal", "CC0"),
    "CC-BY-4.0": ("CC BY 4.0", "the Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "the Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "the Creative Commons Attribution-NonCommercial 4.0 International License"),
}
NOTICES = ("Licensed under", "Released under", "Distributed under", "Available under", *(f"This {what} is {how} under" for what in ("work", "code", "software", "project", "library", "file") for how in ("licensed", "released", "distributed")))
TAG = "SPDX-License-Identifier:"

JUNK = "[^a-z0-9]+"
MARKER = r"^[ \t]*(//+|#+|/?\*+/?|;+|--+)?[ \t]*"
SMALL = r"^[ \t]*[a-z]"
BREAK = r"([a-z][a-z]|[0-9)\"'])([.!?])[ \t-\r]+"
COLON = r"(conditions|restrictions|met):[ \t-\r]+"


def normal(sentence: str) -> str:
    return re.sub(JUNK, " ", sentence.lower()).strip()


def known_forms() -> dict[str, str]:
    """Normal form -> identifier, for sentences without a name, notices and tags."""
    out = {normal(s): k for k, s in SENTENCES.items() if "..." not in s}
    for licence, names in NAMES.items():
        out |= {normal(f"{n} {name}"): f"notice:{licence}" for n in NOTICES for name in names}
    licences = dict.fromkeys([*(r[0] for r in RULES), *NAMES])
    out |= {normal(f"{TAG} {k}{end}"): f"notice:{k}" for k in licences for end in ("", "-only", "-or-later")}
    return out


def named_forms() -> dict[str, str]:
    """LIKE pattern -> identifier, for sentences with a name."""
    return {"%".join(normal(x) for x in s.rstrip(".").split("...")) + "%" * s.endswith("...."): k for k, s in SENTENCES.items() if "..." in s}


def all_rules() -> list[tuple[str, tuple[str, ...]]]:
    return RULES + [(k, (f"notice:{k}",)) for k in dict.fromkeys([*(r[0] for r in RULES), *NAMES])]


def pattern(rule: tuple[str, ...]) -> tuple[str, str]:
    """A regular expression for a rule over identifiers that each have a space before and after, and what it leaves."""
    gap = f"((?: [^ ]+ ){{0,{GAP}}}?)"
    return gap.join(f" {x} " for x in rule), "".join(f"${i + 1}" for i in range(len(rule) - 1))


def sentences(text: Column) -> Column:
    """The normal forms of a text's sentences, in order."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.regexp_replace(x, MARKER, ""))
    space = lambda xs, x, i: ((F.length(x) >= WRAP) | F.coalesce(F.get(xs, i + 1).rlike(SMALL), F.lit(False))) & ~F.contains(x, F.lit(TAG))
    # The array is bound to a variable: an expression would be computed again for each line.
    wrapped = F.get(F.transform(F.array(lines), lambda xs: F.transform(xs, lambda x, i: F.concat(x, F.when(space(xs, x, i), F.lit(" ")).otherwise(F.lit("\n"))))), 0)
    whole = F.lower(F.array_join(wrapped, ""))
    parts = F.split(F.regexp_replace(F.regexp_replace(whole, COLON, "$1\n"), BREAK, "$1\n"), "\n")
    return F.filter(F.transform(parts, lambda s: F.btrim(F.regexp_replace(s, JUNK, " "))), lambda s: s != "")


def identifiers(forms: Column) -> Column:
    """The identifiers of known sentences, in order. Known forms lie in cells by hash: a look-up meets few of them."""
    known, cells = known_forms(), 256
    cell = lambda s: F.pmod(F.xxhash64(s), F.lit(cells)).cast("int")
    table: list[dict[str, str]] = [{} for _ in range(cells)]
    for form, name in known.items():
        table[xxhash.xxh64_intdigest(form.encode(), 42) % cells][form] = name
    none = F.create_map(F.lit(""), F.lit(""))
    maps = F.array(*[F.create_map(*[F.lit(x) for kv in t.items() for x in kv]) if t else none for t in table])
    longest = max(map(len, known))

    def name(s: Column) -> Column:
        out = F.when(F.length(s) <= longest, F.try_element_at(F.get(maps, cell(s)), s))
        for like, k in named_forms().items():
            out = F.coalesce(out, F.when(s.like(like), F.lit(k)))
        return out

    return F.array_compact(F.transform(forms, name))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_sentences, sentence_ids, licenses) per row.

    sentence_ids: identifiers joined by spaces; licenses: licences whose rules match,
    each once, in the order of the rules, joined by commas. Null and blank texts have
    none; whole texts of any length are read; repeated rows come back as often; other
    columns are ignored; an empty table gives none.
    """
    d = docs.select(F.col(doc_id).alias("doc_id"), F.explode(F.array(sentences(F.col(text)))).alias("forms"))
    d = d.select("doc_id", F.size("forms").cast("long").alias("n_sentences"), identifiers(F.col("forms")).alias("ids"))
    rules = [(*pattern(r), k) for k, r in all_rules()]
    table = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(rest).alias("rest"), F.lit(k).alias("k")) for p, rest, k in rules])
    start = F.struct(F.concat(F.lit(" "), F.array_join("ids", "  "), F.lit(" ")).alias("ids"), F.array().cast("array<string>").alias("found"))

    def take(state: Column, rule: Column) -> Column:
        hit = F.regexp_like(state["ids"], rule["p"])
        left = F.when(hit, F.regexp_replace(state["ids"], rule["p"], rule["rest"])).otherwise(state["ids"])
        return F.struct(left.alias("ids"), F.when(hit, F.array_append(state["found"], rule["k"])).otherwise(state["found"]).alias("found"))

    found = F.when(F.size("ids") > 0, F.array_join(F.array_distinct(F.aggregate(table, start, take)["found"]), ",")).otherwise(F.lit(""))
    return d.select("doc_id", "n_sentences", F.array_join("ids", " ").alias("sentence_ids"), found.alias("licenses"))


def oracle(table: str = "documents") -> str:
    """The same for DuckDB, from the rules: rows for lines and sentences, joins for look-ups, a step for each rule."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({q(k)}, {q(v)})" for k, v in known_forms().items())
    named = " ".join(f"WHEN form LIKE {q(like)} THEN {q(k)}" for like, k in named_forms().items())
    steps, last = [], "s0"
    for n, (licence, rule) in enumerate(all_rules(), 1):
        gap = "((?: [^ ]+ ){0,%d}?)" % GAP
        p, rest = q(gap.join(f" {x} " for x in rule)), q("".join(f"\\{i}" for i in range(1, len(rule))))
        steps.append(f"s{n} AS (SELECT r, regexp_replace(ids, {p}, {rest}, 'g') AS ids, CASE WHEN regexp_matches(ids, {p}) AND NOT list_contains(found, {q(licence)}) THEN list_append(found, {q(licence)}) ELSE found END AS found FROM {last})")
        last = f"s{n}"
    return f"""
WITH known(form, name) AS (VALUES {known}),
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM {table}),
raw AS (SELECT r, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM docs),
lines AS (SELECT r, i, regexp_replace(x, {q(MARKER)}, '') AS x FROM raw),
ends AS (SELECT r, i, x, CASE WHEN (length(x) >= {WRAP} OR regexp_matches(lead(x, 1, '') OVER (PARTITION BY r ORDER BY i), {q(SMALL)})) AND NOT contains(x, {q(TAG)}) THEN ' ' ELSE chr(10) END AS e FROM lines),
whole AS (SELECT r, lower(string_agg(x || e, '' ORDER BY i)) AS t FROM ends GROUP BY r),
parts AS (SELECT r, string_split(regexp_replace(regexp_replace(t, {q(COLON)}, '\\1\n', 'g'), {q(BREAK)}, '\\1\n', 'g'), chr(10)) AS s FROM whole),
one AS (SELECT r, unnest(s) AS s, generate_subscripts(s, 1) AS i FROM parts),
forms AS (SELECT r, i, trim(regexp_replace(s, {q(JUNK)}, ' ', 'g')) AS form FROM one),
found AS (SELECT r, count(*) AS n, list(coalesce(name, CASE {named} END) ORDER BY i) FILTER (WHERE coalesce(name, CASE {named} END) IS NOT NULL) AS ids FROM forms LEFT JOIN known USING (form) WHERE form <> '' GROUP BY r),
s0 AS (SELECT r, ' ' || array_to_string(ids, '  ') || ' ' AS ids, []::VARCHAR[] AS found FROM found WHERE len(ids) > 0),
{", ".join(steps)}
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_sentences, coalesce(array_to_string(f.ids, ' '), '') AS sentence_ids, coalesce(array_to_string({last}.found, ','), '') AS licenses FROM docs LEFT JOIN found f USING (r) LEFT JOIN {last} USING (r)
"""
