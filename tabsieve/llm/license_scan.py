"""Licence scan by sentence rules (DataFrame operations only).

A text is first laid out (LAYOUT): marks before a line, as comments have them, go; a copyright line and a list mark begin
a new paragraph; the full stop of "v. 2.0" goes. It is then cut into sentences: at . ! ? before a space or the end, and
between paragraphs; a sentence of several lines is also taken line by line. Sentences that hold one of the words
KEYWORDS are normalised (ASCII lower case; all but letters, digits and . + - become one space) and mapped to the
identifiers of known licence sentences, or of two that a licence prints without a full stop between them (JOINED). The
sequence of identifiers is held against licence rules, in order: a rule takes the places where its identifiers stand
one after the other, and what it has taken is not seen by later rules. There is no shuffle; nothing is broadcast but the
tables in this file.

Results: doc_id, n_known (known sentences), sentence_ids (in order, comma-joined), licenses (distinct, sorted,
comma-joined; null if none), unmatched (identifiers that no rule took, distinct and sorted; null if none). Null and empty
texts have none; repeated rows and null ids are kept; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licences and notices.
SENTENCES: list[tuple[str, str]] = [
    ("rights", "All rights reserved"),
    ("mit-short", "Released under the MIT License"),
    ("mit-short", "Licensed under the MIT License"),
    ("mit-short", "This project is licensed under the MIT License"),
    ("mit-grant", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),  # noqa: E501
    ("mit-notice", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("as-is", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT'),
    ("isc-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc-as-is", 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS'),
    ("bsd-grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd-source", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd-binary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("bsd-names", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("apache-short", "Licensed under the Apache License, Version 2.0"),
    ("apache-header", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License'),
    ("apache-copy", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-copy", "You may obtain a copy of the License at"),
    ("apache-as-is", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied'),
    ("gpl2-short", "This work is licensed under the GNU General Public License, version 2"),
    ("gpl3-short", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl2-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),  # noqa: E501
    ("gpl3-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),  # noqa: E501
    ("gpl-warranty", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"),
    ("gpl-details", "See the GNU General Public License for more details"),
    ("mpl2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("public-domain", "This is free and unencumbered software released into the public domain"),
    ("spdx-mit", "SPDX-License-Identifier: MIT"),
    ("spdx-apache", "SPDX-License-Identifier: Apache-2.0"),
]
for _kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
    for _v in ("2.0", "3.0", "4.0"):
        SENTENCES += [(f"cc-{_kind.lower()}-{_v}", f"Licensed under CC {_kind} {_v}"), (f"cc-{_kind.lower()}-{_v}", f"This work is licensed under CC {_kind} {_v}")]

# Ordered rules, the more specific first.
RULES: list[tuple[str, list[str]]] = [
    ("MIT", ["mit-grant", "mit-notice", "as-is"]),
    ("ISC", ["isc-grant", "isc-as-is"]),
    ("BSD-3-Clause", ["rights", "bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-2-Clause", ["rights", "bsd-grant", "bsd-source", "bsd-binary"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("Apache-2.0", ["apache-header", "apache-copy", "apache-as-is"]),
    ("GPL-2.0-or-later", ["gpl2-later", "gpl-warranty", "gpl-details"]),
    ("GPL-3.0-or-later", ["gpl3-later", "gpl-warranty", "gpl-details"]),
    ("GPL-2.0-or-later", ["gpl2-later"]),
    ("GPL-3.0-or-later", ["gpl3-later"]),
    ("GPL-2.0-only", ["gpl2-short"]),
    ("GPL-3.0-only", ["gpl3-short"]),
    ("Apache-2.0", ["apache-header"]),
    ("Apache-2.0", ["apache-short"]),
    ("Apache-2.0", ["spdx-apache"]),
    ("MIT", ["mit-short"]),
    ("MIT", ["spdx-mit"]),
    ("MPL-2.0", ["mpl2"]),
    ("Unlicense", ["public-domain"]),
    ("All-rights-reserved", ["rights"]),
]
RULES += [(i.upper(), [i]) for i in dict.fromkeys(i for i, _ in SENTENCES if i.startswith("cc-"))]

KEYWORDS = ["licen", "rights reserved", "permission", "copyright", "redistribut", "warrant", "public domain"]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_KEY = "(?i)" + "|".join(KEYWORDS).replace(" ", r"[ \t\r\n]+")
_END = r"[.!?]+([ \t\r\n]+|$)"
_OTHER = "[^a-z0-9.+-]+"

#: (pattern, what comes in its place), in order; `^` and `$` are those of lines, case is not looked at.
LAYOUT: list[tuple[str, str]] = [
    (r"^[ \t/*#;%>-]+", ""),
    (r"^copyright[ \t]+(\(c\)|©|[0-9])[^\n]*?(all rights reserved|$)", "\n\n\\2"),
    (r"^\(?([0-9]{1,2}|[a-z]|[ivx]{1,4})[.)][ \t]+([a-z(])", "\n\n\\2"),
    (r"\bv\.([ \t\r\n]+[0-9])", "v\\1"),
]
_CUT = _END + r"|\n[ \t\r]*\n[ \t\r\n]*"


def normal(sentence: str) -> str:
    s = re.sub(_END + r"$", " ", re.sub(LAYOUT[-1][0], r"v\1", sentence, flags=re.I))
    s = re.sub(_OTHER, " ", s.translate(str.maketrans(_UPPER, _LOWER))).replace("licence", "license")
    return s.strip(" .+-")


KNOWN: dict[str, list[str]] = {normal(text): [i] for i, text in SENTENCES}
assert all(re.search(_KEY, text) for text in KNOWN)

# Sentences that follow each other without a full stop or a blank line.
JOINED = [["mit-grant", "mit-notice"], ["bsd-grant", "bsd-source"], ["apache-copy", "apache-as-is"]]
for _ids in JOINED:
    KNOWN[" ".join(next(s for s, i in KNOWN.items() if i == [of]) for of in _ids)] = _ids


def _normal(s: Column) -> Column:
    s = F.replace(F.regexp_replace(F.translate(s, _UPPER, _LOWER), _OTHER, " "), F.lit("licence"), F.lit("license"))
    return F.btrim(s, F.lit(" .+-"))


def sentence_ids(text: Column) -> Column:
    """The identifiers of the known sentences of a text, in order, each in angle brackets."""
    known = F.create_map(*[F.lit(x) for s, ids in KNOWN.items() for x in (s, _sequence(ids))])
    text = F.when(text.rlike(_KEY), text).otherwise("")
    for pattern, new in LAYOUT:
        text = F.regexp_replace(text, "(?imd)" + pattern, new.replace("\\", "$"))
    units = F.filter(F.split(text, _CUT), lambda u: u.rlike(_KEY))
    forms = F.flatten(F.transform(units, lambda u: F.when(F.instr(u, "\n") > 0, F.concat(F.array(u), F.split(u, "\n"))).otherwise(F.array(u))))
    ids = F.transform(forms, lambda u: F.try_element_at(known, _normal(u)))
    return F.concat_ws("", F.filter(ids, lambda i: i.isNotNull()))


def _sequence(ids: list[str]) -> str:
    return "".join(f"<{i}>" for i in ids)


def scan(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text."""
    found = docs.select("doc_id", sentence_ids(F.coalesce("text", F.lit(""))).alias("seq"))
    taken = reduce(lambda s, rule: F.replace(s, F.lit(_sequence(rule[1])), F.lit(f"[{rule[0]}]")), RULES, F.col("seq"))
    found = found.select("doc_id", "seq", taken.alias("taken"))
    pick = lambda of: F.concat_ws(",", F.array_sort(F.array_distinct(of)))
    ids = F.regexp_extract_all("seq", F.lit("<([^>]+)>"), 1)
    licenses, rest = pick(F.regexp_extract_all("taken", F.lit(r"\[([^\]]+)\]"), 1)), pick(F.regexp_extract_all("taken", F.lit("<([^>]+)>"), 1))
    return found.select(
        "doc_id",
        F.size(ids).cast("long").alias("n_known"),
        F.concat_ws(",", ids).alias("sentence_ids"),
        F.nullif(licenses, F.lit("")).alias("licenses"),
        F.nullif(rest, F.lit("")).alias("unmatched"),
    )


def oracle() -> str:
    """The same in DuckDB's SQL, by rows and joins instead of arrays."""
    text = lambda s: "'" + s.replace("'", "''") + "'"
    norm = f"trim(replace(regexp_replace(translate(u, '{_UPPER}', '{_LOWER}'), '{_OTHER}', ' ', 'g'), 'licence', 'license'), ' .+-')"
    taken = reduce(lambda s, rule: f"replace({s}, '{_sequence(rule[1])}', '[{rule[0]}]')", RULES, "seq")
    laid = reduce(lambda s, x: f"regexp_replace({s}, '(?im){x[0]}', {text(x[1])}, 'g')", LAYOUT, "coalesce(text, '')")
    return f"""
        WITH known(s, k, id) AS (VALUES {", ".join(f"({text(s)}, {k}, {text(i)})" for s, ids in KNOWN.items() for k, i in enumerate(ids))}),
        a AS (SELECT row_number() OVER () AS r, doc_id, {laid} AS text FROM documents),
        b AS (SELECT r, unnest(string_split_regex(text, '{_CUT}')) AS u, generate_subscripts(string_split_regex(text, '{_CUT}'), 1) AS i FROM a),
        c AS (SELECT r, i, unnest(CASE WHEN contains(u, chr(10)) THEN [u] || string_split(u, chr(10)) ELSE [u] END) AS u,
                     generate_subscripts(CASE WHEN contains(u, chr(10)) THEN [u] || string_split(u, chr(10)) ELSE [u] END, 1) AS j FROM b),
        d AS (SELECT r, string_agg(id, ',' ORDER BY i, j, k) AS sentence_ids, count(*) AS n_known, string_agg('<' || id || '>', '' ORDER BY i, j, k) AS seq
              FROM c JOIN known ON known.s = {norm} GROUP BY r),
        e AS (SELECT *, {taken} AS taken FROM d)
        SELECT a.doc_id, coalesce(n_known, 0) AS n_known, coalesce(sentence_ids, '') AS sentence_ids,
               nullif(array_to_string(list_sort(list_distinct(regexp_extract_all(taken, '\\[([^\\]]+)\\]', 1))), ','), '') AS licenses,
               nullif(array_to_string(list_sort(list_distinct(regexp_extract_all(taken, '<([^>]+)>', 1))), ','), '') AS unmatched
        FROM a LEFT JOIN e USING (r)"""
