"""Licences of texts, by rules over the sentences that licences are made of.

A text is cut into sentences, twice: with line ends as boundaries (for notices on a line of
their own) and without (for sentences wrapped over lines; a blank line and a copyright line
end a sentence there too). A normalised sentence that is
known becomes its identifier, others are dropped. The identifiers in their order are
matched with the rules, the longest first; what a rule has matched no other rule sees.

DataFrame operations only. Every known sentence and every pattern has a word that a text
must hold for it to match; texts with none of these words are not cut at all.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Known sentences, normalised, and the rules.
SENTENCES = {
    "mit-ref": "released under the mit license",
    "gpl3-ref": "this work is licensed under the gnu general public license version 3",
    "ccbync4-ref": "licensed under cc by nc 4.0",
    "apache2-ref": "licensed under the apache license version 2.0",
    "apache2-head": "licensed under the apache license version 2.0 the license",
    "apache2-use": "you may not use this file except in compliance with the license",
    "apache2-copy": "you may obtain a copy of the license at",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "gpl3-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "cc0": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
}
RULES = (
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("Apache-2.0", ("apache2-head", "apache2-use", "apache2-copy")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("Apache-2.0", ("apache2-ref",)),
    ("CC-BY-NC-4.0", ("ccbync4-ref",)),
    ("CC0-1.0", ("cc0",)),
    ("GPL-3.0-or-later", ("gpl3-free",)),
    ("GPL-3.0-only", ("gpl3-ref",)),
    ("MIT", ("mit-ref",)),
)
# Beyond the SQL: known sentences and rules of which the test tables have none, and patterns
# for sentences with a name in them.
MORE_SENTENCES = {
    "gpl-free": "this program is free software",
    "gpl-terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "lgpl-free": "this library is free software",
    "lgpl-terms": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "agpl-terms": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation",
    "later-2": "either version 2 of the license or at your option any later version",
    "later-2.1": "either version 2.1 of the license or at your option any later version",
    "later-3": "either version 3 of the license or at your option any later version",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mpl-head": "this source code form is subject to the terms of the mozilla public license v",
    "unlicense": "this is free and unencumbered software released into the public domain",
}
for _of in ("gpl", "lgpl", "agpl"):
    for _version in ("2", "2.1", "3"):
        MORE_SENTENCES[f"{_of}{_version}-later"] = f"{MORE_SENTENCES[f'{_of}-terms']} {MORE_SENTENCES[f'later-{_version}']}"
_COPYLEFT = (("GPL", "gpl", "2"), ("GPL", "gpl", "3"), ("LGPL", "lgpl", "2.1"), ("LGPL", "lgpl", "3"), ("AGPL", "agpl", "3"))
#: What short notices call a licence.
SHORT = {
    "MIT": "mit license", "ISC": "isc license", "Apache-2.0": "apache license( version)? 2.0", "BSD-2-Clause": "bsd 2 clause license",
    "BSD-3-Clause": "bsd 3 clause license", "GPL-2.0-only": "gnu general public license (version |v)2(.0)?", "GPL-3.0-only": "gnu general public license (version |v)3(.0)?",
    "LGPL-3.0-only": "gnu lesser general public license (version |v)3(.0)?", "AGPL-3.0-only": "gnu affero general public license (version |v)3(.0)?",
    "MPL-2.0": "mozilla public license( version)? 2.0", "CC-BY-4.0": "cc by 4.0", "CC-BY-SA-4.0": "cc by sa 4.0", "CC-BY-NC-4.0": "cc by nc 4.0",
}
_OPENING = "((this|the|all) ([a-z0-9.]+ ){0,6}(is|are) )?(licensed|released|distributed|available|made available|provided) under (the )?(terms (and conditions )?of )?(the )?"
PATTERNS = {
    "bsd-names": "neither the names? of .{1,120} nor the names of (its|their|other) contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "mpl2-copy": "if a copy of the mpl was not distributed with this file you can obtain one at https? (www.)?mozilla.org mpl 2.0",
} | {f"short-{name}": _OPENING + wording.replace(".", "[.]") for name, wording in SHORT.items()}
MORE_RULES = (
    *((f"{name}-{float(v):.1f}-or-later", ids) for name, of, v in _COPYLEFT for ids in (("gpl-free", f"{of}{v}-later"), (f"{of}-terms", f"later-{v}"), (f"{of}{v}-later",))),
    ("MPL-2.0", ("mpl-head", "mpl2-copy")),
    ("ISC", ("isc-grant",)),
    ("Unlicense", ("unlicense",)),
    *((name, (f"short-{name}",)) for name in SHORT),
)


def _needed() -> list[str]:
    """Words of which each known sentence and pattern holds one: the longest of each, but
    for those that hold a word already taken."""
    plain = [s.split() for s in (*SENTENCES.values(), *MORE_SENTENCES.values())]
    for name, pattern in PATTERNS.items():
        wording = SHORT[name.removeprefix("short-")] if name.startswith("short-") else pattern
        fixed = re.sub(r"\([^()]*\)[?]?|\S*[{}?*]\S*", " ", wording).split()
        plain.append([w for w in fixed if name.startswith("short-") or w.isalpha()])
    words: list[str] = []
    for sentence in sorted(plain, key=lambda s: len(max(s, key=len))):
        if not any(taken in word for taken in words for word in sentence):
            words.append(max(sentence, key=len))
    return words


ANCHOR = "(?i)" + "|".join(map(re.escape, _needed()))
ENDS = r"[.!?;:]+[ \t\r\n]+"
#: A blank line, also of a comment; a line that says whose the copyright is.
BLANK = r"\n[ \t\r*#/;-]*\n"
OWNER = r"(?im)^[ \t*#/;-]*copyright[ \t]+(?:\(c\)|©|[0-9]{4})[^\n]*$"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def sentence_ids(text: Column, ends: str) -> Column:
    """``<id>`` of every known sentence, in order, as one string."""
    known = F.create_map(*(F.lit(x) for name, s in SENTENCES.items() for x in (s, name)))
    more = F.create_map(*(F.lit(x) for name, s in MORE_SENTENCES.items() for x in (s, name)))

    def normal(s: Column) -> Column:
        plain = F.regexp_replace(F.translate(s, _UPPER, _LOWER), "[^a-z0-9.]+", " ")
        return F.regexp_replace(F.regexp_replace(plain, "^[ .]+", ""), "[ .]+$", "")

    def name(s: Column) -> Column:
        fits = (F.when(s.rlike(f"^(?:{pattern})$"), F.lit(name)) for name, pattern in PATTERNS.items())
        hinted = F.when(s.rlike("license|cc by|neither the name|mpl"), F.coalesce(*fits))
        return F.coalesce(F.try_element_at(known, s), F.try_element_at(more, s), hinted)

    names = F.transform(F.transform(F.split(text, ends, -1), normal), name)
    return F.array_join(F.transform(F.filter(names, lambda n: n.isNotNull()), lambda n: F.concat(F.lit("<"), n, F.lit(">"))), "")


def matched(sequence: Column) -> Column:
    """The licences whose rules match, in the order of the rules."""
    found = []
    for licence, names in sorted(RULES + MORE_RULES, key=lambda r: -len(r[1])):
        wanted = "".join(f"<{n}>" for n in names)
        found.append(F.when(F.contains(sequence, F.lit(wanted)), F.lit(licence)))
        sequence = F.replace(sequence, F.lit(wanted), F.lit("#"))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def license_scan(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``docs`` without the text, with ``sentence_ids`` (cut at line ends), ``licenses``
    (distinct, by code point, comma-joined) and ``n_licenses``.

    A NULL text has no licences. Repeated rows get equal results, an empty table gives an
    empty result, columns with the names of new ones are replaced.
    """
    others = [c for c in docs.columns if c not in (text_column, "sentence_ids", "licenses", "n_licenses", "_wrapped")]
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    likely = text.rlike(ANCHOR)

    def ids(text: Column, ends: str) -> Column:
        return F.when(likely, sentence_ids(text, ends)).otherwise("")

    owned = F.regexp_replace(text, OWNER, "\n\n")
    cut = docs.select(*(f"`{c}`" for c in others), ids(text, rf"{ENDS}|\n").alias("sentence_ids"), ids(owned, f"{ENDS}|{BLANK}").alias("_wrapped"))
    both = F.array_sort(F.array_distinct(F.concat(matched(F.col("sentence_ids")), matched(F.col("_wrapped")))))
    found = cut.withColumn("_found", both)
    return found.select(
        *(f"`{c}`" for c in others), "sentence_ids", F.array_join("_found", ",").alias("licenses"), F.size("_found").cast("long").alias("n_licenses")
    )


def scan_sql() -> str:
    """The scan in DuckDB SQL, from the fixed values that occur in the test tables."""
    known = "MAP {" + ", ".join(f"'{s}': '{n}'" for n, s in SENTENCES.items()) + "}"

    def ids(ends: str) -> str:
        normal = "regexp_replace(regexp_replace(regexp_replace(translate(s, '" + _UPPER + "', '" + _LOWER + "'), '[^a-z0-9.]+', ' ', 'g'), '^[ .]+', ''), '[ .]+$', '')"
        return f"list_aggregate(list_filter(list_transform(string_split_regex(coalesce(text, ''), '{ends}'), lambda s: {known}[{normal}]), lambda n: n IS NOT NULL), 'string_agg', '><')"

    def found(column: str) -> str:
        cases, rest = [], column
        for licence, names in sorted(RULES, key=lambda r: -len(r[1])):
            wanted = "".join(f"<{n}>" for n in names)
            cases.append(f"CASE WHEN contains({rest}, '{wanted}') THEN '{licence}' END")
            rest = f"replace({rest}, '{wanted}', '#')"
        return "[" + ", ".join(cases) + "]"

    return rf"""
        WITH cut AS (
            SELECT doc_id, {ids(ENDS + '|\n')} AS a, {ids(ENDS)} AS b FROM documents
        ), sequences AS (
            SELECT doc_id, coalesce('<' || a || '>', '') AS sentence_ids, coalesce('<' || b || '>', '') AS wrapped FROM cut
        ), found AS (
            SELECT *, list_sort(list_distinct(list_filter(list_concat({found('sentence_ids')}, {found('wrapped')}), lambda x: x IS NOT NULL))) AS licences FROM sequences
        )
        SELECT doc_id, sentence_ids, coalesce(array_to_string(licences, ','), '') AS licenses, len(licences)::BIGINT AS n_licenses FROM found
    """
