"""Licence scans by sentence rules, with SQL functions only.

A text is cut into sentences, which are normalised and mapped to identifiers of known licence sentences; a licence is
found where the identifiers in a row are those of one of its rules, with at most GAP unknown sentences between two of
them. All rules are one pattern over the identifiers, in which the longer of two rules comes first and uses up what it
matches. Lines are taken as sentence ends first; then, for wrapped licence texts, as plain space. The rules' sentences
come from the licences' own words by the same cuts and normal form.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

GAP = 2
MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished "
    "to do so, subject to the following conditions: "
)
MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
MIT_AS_IS = (
    "The Software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. "
)
BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
BSD_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
BSD_BINARY = (
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
BSD_NAMES = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
)
BSD_ADVERTS = "All advertising materials mentioning features or use of this software must display the following acknowledgement: "
GNU = {"GPL": "GNU General Public License", "LGPL": "GNU Lesser General Public License", "AGPL": "GNU Affero General Public License"}
GNU_VERSIONS = [("GPL", "2", "2.0"), ("GPL", "3", "3.0"), ("LGPL", "2.1", "2.1"), ("LGPL", "3", "3.0"), ("AGPL", "3", "3.0")]
GNU_DATES = {("GPL", "2"): "June 1991", ("GPL", "3"): "29 June 2007", ("LGPL", "2.1"): "February 1999", ("LGPL", "3"): "29 June 2007", ("AGPL", "3"): "19 November 2007"}
CC = {
    "BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}

# Passages of public licences, or of the notices that name them, in the order in which they are tried.
PASSAGES = [
    ("MIT", MIT_GRANT + MIT_NOTICE + MIT_AS_IS),
    ("MIT", MIT_GRANT + MIT_NOTICE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License). You may not use this file except in compliance with the License. "),
    ("BSD-4-Clause", BSD_GRANT + BSD_SOURCE + BSD_BINARY + BSD_ADVERTS),
    ("BSD-3-Clause", BSD_GRANT + BSD_SOURCE + BSD_BINARY + BSD_NAMES),
    ("BSD-2-Clause", BSD_GRANT + BSD_SOURCE + BSD_BINARY),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "),
    ("ISC", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: "),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. "),
    ("Unlicense", "This is free and unencumbered software released into the public domain. "),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. "),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at "),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0 which is available at "),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("MIT", "Released under the MIT License. "),
    ("MIT", "Licensed under the MIT License. "),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0. "),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3. "),
    ("CC0-1.0", "Licensed under CC0 1.0. "),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. "),
]
SPDX = [
    "MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "ISC", "Zlib", "BSL-1.0", "Unlicense", "MPL-2.0", "EPL-2.0", "CC0-1.0",
    *[f"{k}-{v}-{end}" for k, _, v in GNU_VERSIONS for end in ("only", "or-later")], *[f"CC-{k}-4.0" for k in CC],
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARAGRAPH = "\x1e"

# Patterns of the normal form, alike in Java, RE2 and Python.
CUTS = r"([.!?;:])[ \t\r\f\n]+"
OTHER_SIGNS = "[^a-z0-9]+"
LIST_MARK = "^([0-9]{1,3}|[a-h])( |$)"
HOLDER = "^neither the names? of .{1,120} nor the names of "
ANY_HOLDER = "neither the name of the copyright holder nor the names of "


def _notices() -> list[tuple[str, str]]:
    """The notices of the GNU licences in the forms in use, and the short references of the CC ones."""
    out = []
    for kind, version, spdx in GNU_VERSIONS:
        for what in ("program", "library", "file"):
            for stop in (";", ":"):
                for comma in (",", ";"):
                    free = f"This {what} is free software{stop} you can redistribute it and/or modify it under the terms of the {GNU[kind]} as published by the Free Software Foundation{comma} "
                    out.append((f"{kind}-{spdx}-or-later", free + f"either version {version} of the License, or (at your option) any later version. "))
                    out.append((f"{kind}-{spdx}-only", free + f"version {version} of the License. "))
                    out.append((f"{kind}-{spdx}-only", free + f"version {version}. "))
        # the licences' own first lines say nothing about later versions
        out.append((f"{kind}-{spdx}-only", f"{GNU[kind]}\nVersion {version}, {GNU_DATES[kind, version]}"))
        out.append((f"{kind}-{spdx}-only", f"{GNU[kind]} Version {version}, {GNU_DATES[kind, version]}"))
    for kind, name in CC.items():
        for text in (f"Licensed under CC {kind} 4.0. ", f"This work is licensed under CC {kind} 4.0. ", f"This work is licensed under a Creative Commons {name} 4.0 International License. "):
            out.append((f"CC-{kind}-4.0", text))
    return out + [(name, f"SPDX-License-Identifier: {name}") for name in SPDX]


def sentences_of(text: str) -> list[str]:
    """A passage's sentences in normal form, by the cuts that texts are cut with."""
    out = []
    for s in re.sub(CUTS, r"\1\n", text).split("\n"):
        s = re.sub(OTHER_SIGNS, " ", s.lower()).strip()
        out.append(re.sub(HOLDER, ANY_HOLDER, re.sub(LIST_MARK, "", s)))
    return [s for s in out if s]


def _rules() -> tuple[dict[str, str], list[tuple[str, list[str]]]]:
    """Sentence -> identifier, and (licence, identifiers) with longer rules first."""
    known: dict[str, str] = {}
    rules = []
    for name, passage in PASSAGES + _notices():
        rules.append((name, [known.setdefault(s, f"s{len(known)}") for s in sentences_of(passage)]))
    return known, sorted(rules, key=lambda r: -len(r[1]))


SENTENCES, RULES = _rules()
PATTERN = "|".join(dict.fromkeys((r"(?:\?,){0,%d}" % GAP).join(f"{s}," for s in parts) for _, parts in RULES))
LICENCES = {}
for _name, _parts in RULES:
    LICENCES.setdefault("".join(f"{s}," for s in _parts), _name)


def _known(text: Column) -> Column:
    """Identifiers of a text's sentences in order, each before a comma; an unknown one is '?'.

    The number, letter or bullet of a list's item is no sentence, nor part of one.
    """
    keys = F.create_map(*[F.lit(x) for item in SENTENCES.items() for x in item])
    cut = F.split(F.regexp_replace(text, CUTS, "$1\n"), "\n")
    normal = F.transform(cut, lambda s: F.trim(F.regexp_replace(F.translate(s, UPPER, LOWER), OTHER_SIGNS, " ")))
    bare = F.transform(normal, lambda s: F.regexp_replace(F.regexp_replace(s, LIST_MARK, ""), HOLDER, ANY_HOLDER))
    return F.array_join(F.transform(F.filter(bare, lambda s: s != ""), lambda s: F.concat(F.coalesce(F.try_element_at(keys, s), F.lit("?")), F.lit(","))), "")


def _unwrapped(text: Column) -> Column:
    """Lines of a paragraph joined, also where a comment's or a quote's signs begin each; empty lines still end one."""
    plain = F.regexp_replace(text, r"\n[ \t\r]*(?:[*#>;]|//|--)+[ \t]?", "\n")
    marked = F.regexp_replace(F.regexp_replace(plain, r"\n[ \t\r]*\n", PARAGRAPH), r"[\r\n]+", " ")
    return F.replace(marked, F.lit(PARAGRAPH), F.lit("\n"))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_sentences (recognised ones) and licenses (sorted names joined by commas).

    docs needs doc_id and text; other columns are ignored. A null, empty or blank text has no sentence and no
    licence (an empty string); repeated rows are each scanned; long texts are scanned whole.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    cut = docs.select("doc_id", _known(text).alias("ids"), _known(_unwrapped(text)).alias("wrapped"))
    names = F.create_map(*[F.lit(x) for item in LICENCES.items() for x in item])
    met = lambda c: F.transform(F.regexp_extract_all(c, F.lit(PATTERN), 0), lambda m: F.element_at(names, F.replace(m, F.lit("?,"), F.lit(""))))
    found = F.array_join(F.array_sort(F.array_distinct(F.concat(met("ids"), met("wrapped")))), ",")
    count = lambda c: F.length(F.regexp_replace(c, "[^s]", ""))
    some = F.contains(F.concat("ids", "wrapped"), F.lit("s"))  # most texts hold no known sentence
    return cut.select("doc_id", F.greatest(count("ids"), count("wrapped")).cast("long").alias("n_sentences"), F.when(some, found).otherwise("").alias("licenses"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def _sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    keys = ", ".join(f"{quoted(s)}: '{n}'" for s, n in SENTENCES.items())
    names = ", ".join(f"'{k}': '{v}'" for k, v in LICENCES.items())
    bare = f"regexp_replace(regexp_replace(trim(regexp_replace(translate(s, '{UPPER}', '{LOWER}'), '{OTHER_SIGNS}', ' ', 'g')), '{LIST_MARK}', ''), '{HOLDER}', '{ANY_HOLDER}')"
    ids = lambda text: (
        f"coalesce(array_to_string(list_transform(list_filter(list_transform(string_split(regexp_replace({text}, '{CUTS}', '\\1' || chr(10), 'g'), chr(10)), lambda s: {bare}), lambda s: s <> ''), lambda s: coalesce((MAP {{{keys}}})[s], '?') || ','), ''), '')"
    )
    plain = "regexp_replace(coalesce(text, ''), '\\n[ \\t\\r]*(?:[*#>;]|//|--)+[ \\t]?', chr(10), 'g')"
    unwrapped = f"replace(regexp_replace(regexp_replace({plain}, '\\n[ \\t\\r]*\\n', chr(30), 'g'), '[\\r\\n]+', ' ', 'g'), chr(30), chr(10))"
    met = lambda c: f"list_transform(regexp_extract_all({c}, '{PATTERN}', 0), lambda m: (MAP {{{names}}})[replace(m, '?,', '')])"
    count = lambda c: f"length(regexp_replace({c}, '[^s]', '', 'g'))"
    return (
        f"with k as (select doc_id, {ids("coalesce(text, '')")} as ids, {ids(unwrapped)} as wrapped from documents)"
        f" select doc_id, cast(greatest({count('ids')}, {count('wrapped')}) as bigint) as n_sentences, coalesce(array_to_string(list_sort(list_distinct(list_concat({met('ids')}, {met('wrapped')}))), ','), '') as licenses from k"
    )


SQL = _sql()
