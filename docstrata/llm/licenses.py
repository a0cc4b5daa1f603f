"""Licence scans: normalised text compared with licence templates by the Dice coefficient over word bigrams.

The segments of a document are its lines, its paragraphs (runs of lines between blank ones) and its whole text. A
segment and a template that differ too much in size cannot reach the least coefficient, so only templates within the
size bounds are compared. A template that names a version needs a segment that names it too. Only DataFrame functions, no shuffle: every row is judged where it is read.
"""

from __future__ import annotations

import re
import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docstrata.llm.quality import let

DICE_LEAST = 0.8

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
this permission notice shall be included in all copies or substantial portions of the Software."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies."""
_BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution."""
_BSD3 = _BSD2 + """ 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License."""
_GPL3 = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
later version."""
_MPL2 = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""

_GPL2 = _GPL3.replace("version 3", "version 2")
_LGPL3 = _GPL3.replace("General Public", "Lesser General Public")
_LGPL21 = """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General
Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any
later version."""
_AGPL3 = _GPL3.replace("General Public", "Affero General Public")
_MIT_WHOLE = _MIT + """ THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_CC0 = """To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this
software to the public domain worldwide. This software is distributed without any warranty."""

#: Identifiers of licences as source files name them, and the licence each stands for.
SPDX: tuple[tuple[str, str], ...] = (
    ("AGPL-3.0", "AGPL-3.0-only"), ("AGPL-3.0", "AGPL-3.0-or-later"), ("Apache-2.0", "Apache-2.0"), ("BSD-2-Clause", "BSD-2-Clause"),
    ("BSD-3-Clause", "BSD-3-Clause"), ("CC-BY-4.0", "CC-BY-4.0"), ("CC-BY-SA-4.0", "CC-BY-SA-4.0"), ("CC0-1.0", "CC0-1.0"),
    ("GPL-2.0", "GPL-2.0-only"), ("GPL-2.0", "GPL-2.0-or-later"), ("GPL-3.0", "GPL-3.0-only"), ("GPL-3.0", "GPL-3.0-or-later"),
    ("ISC", "ISC"), ("LGPL-2.1", "LGPL-2.1-only"), ("LGPL-2.1", "LGPL-2.1-or-later"), ("LGPL-3.0", "LGPL-3.0-only"),
    ("LGPL-3.0", "LGPL-3.0-or-later"), ("MIT", "MIT"), ("MPL-2.0", "MPL-2.0"), ("Unlicense", "Unlicense"),
)

#: Licence id and template text. An id may have several templates.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("AGPL-3.0", _AGPL3),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", _BSD2),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", _BSD3),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", _CC0),
    ("GPL-2.0", _GPL2),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", _GPL3),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", _ISC),
    ("LGPL-2.1", _LGPL21),
    ("LGPL-3.0", _LGPL3),
    ("MIT", _MIT),
    ("MIT", _MIT_WHOLE),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "MIT License"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "The MIT License"),
    ("MPL-2.0", _MPL2),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    *((name, f"SPDX-License-Identifier: {said}") for name, said in SPDX),
)

#: Words that name a version with the number that follows. Such a pair of a template has to stand in what is
#: compared with it: licences that differ in their version share nearly all of their text.
VERSIONED = (
    "version v license apache gpl lgpl agpl mpl bsd cc0 by nc sa attribution noncommercial sharealike"
).split()


def versions(grams: set[str]) -> list[str]:
    """The pairs of a template that name a version."""
    return sorted(g for g in grams if (p := g.split(" "))[0] in VERSIONED and p[1].isdigit() and p[1].isascii())


def bigram_set(text: str) -> set[str]:
    """Distinct word bigrams of a normalised text; as `bigrams` has them."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\W_]+", low)
    return {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}


def bigrams(text: Column) -> Column:
    """Distinct word bigrams; A-Z lower-cased, words are runs of letters and digits."""
    low = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    words = F.filter(F.split(low, r"[^\p{L}\p{N}]+", -1), lambda w: w != "")

    def pairs(w: Column) -> Column:
        n = F.size(w)
        at = F.when(n >= 2, F.sequence(F.lit(0), n - 2)).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(at, lambda i: F.concat(F.get(w, i), F.lit(" "), F.get(w, i + 1))))

    return let(words, pairs)


def segments(text: Column) -> Column:
    """Distinct lines, paragraphs and the whole text, those without a visible character left out."""
    whole = F.coalesce(text, F.lit(""))
    parts = F.concat(F.split(whole, "\n", -1), F.split(whole, r"\n[\x20\x09-\x0D]*\n", -1), F.array(whole))
    return F.filter(F.array_distinct(parts), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))


def matches(text: Column, templates: Sequence[tuple[str, str]], dice_least: float) -> Column:
    """Array of (dice, license, segment), one for each segment that reaches `dice_least`: its best template, of equally
    good ones the one with the smallest id."""
    sets = [(name, sorted(bigram_set(body))) for name, body in templates]
    if not sets:
        return F.array().cast("array<struct<dice:double,license:string,segment:string>>")
    names = F.array(*[F.lit(name) for name, _ in sets])
    known = sorted({b for _, found in sets for b in found})

    def best(segment: Column) -> Column:
        def judge(found: Column) -> Column:
            n = F.size(found)

            def score(shared: Column) -> Column:
                options = []
                for name, body in sets:
                    size = len(body)
                    low, high = dice_least / (2 - dice_least) * size, (2 - dice_least) / dice_least * size
                    both = F.size(F.array_intersect(shared, F.array(*map(F.lit, body))))
                    dice = F.lit(2.0) * both / (n + size)
                    fits = (n >= low) & (n <= high) & (2 * F.size(shared) >= dice_least * (n + size))
                    for named in versions(set(body)):
                        fits = fits & F.array_contains(shared, named)
                    options.append(F.when(fits, dice))
                # The first of equal scores: the templates are in order of their ids.
                return let(
                    F.array(*options),
                    lambda o: F.struct(
                        F.array_max(o).alias("dice"),
                        F.get(names, F.array_position(o, F.array_max(o)).cast("int") - 1).alias("license"),
                        segment.alias("segment"),
                    ),
                )

            def scored(shared: Column) -> Column:
                return F.when(F.size(shared) > 0, score(shared))

            return let(F.filter(found, lambda b: b.isin(known)), scored)

        return let(bigrams(segment), judge)

    return F.filter(F.transform(segments(text), best), lambda m: m.isNotNull() & (m["dice"] >= dice_least))


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    dice_least: float = DICE_LEAST,
) -> DataFrame:
    """doc_id, license, dice (the best match), licenses (all, sorted) and matches for every row of `docs`.

    A null, empty or blank text, and one without a match, has null, null and empty arrays. Of equally good licences the
    smallest id is named. Repeated rows give a row each, an empty table an empty result; other columns are ignored.
    `templates` (id, text) are a list in the program, not a table.
    """
    if not 0 < dice_least <= 1:
        raise ValueError("dice_least is above 0 and at most 1")
    ranked = sorted(templates)
    found = docs.select(
        F.col(id_col).alias("doc_id"), matches(F.col(text_col).cast("string"), ranked, dice_least).alias("matches")
    )
    order = F.array_sort(F.transform("matches", lambda m: F.struct((-m["dice"]).alias("d"), m["license"].alias("license"))))
    return found.select(
        "doc_id",
        F.get(order, F.lit(0))["license"].alias("license"),
        (-F.get(order, F.lit(0))["d"]).alias("dice"),
        F.array_sort(F.array_distinct(F.col("matches.license"))).alias("licenses"),
        "matches",
    )


def _sql() -> str:
    rows = ", ".join(f"""({i}, '{name}', '{body.replace("'", "''")}')""" for i, (name, body) in enumerate(sorted(TEMPLATES)))
    named = f"regexp_full_match(gram, '({'|'.join(VERSIONED)}) [0-9]+')"
    grams = (
        "list_distinct(list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1]))"
    )
    words = r"list_filter(regexp_split_to_array(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
    return rf"""
with t as (select * from (values {rows}) as v(tid, license, body)),
tw as (select tid, license, {words.format(t="body")} as w from t),
tg as (select tid, license, {grams.format(w="w")} as g from tw),
s as (
  select doc_id, unnest(list_distinct(list_concat(string_split(coalesce(text, ''), chr(10)),
    regexp_split_to_array(coalesce(text, ''), '\n[\x20\x09-\x0D]*\n'), [coalesce(text, '')]))) as segment from documents),
sw as (select doc_id, segment, {words.format(t="segment")} as w from s where regexp_matches(segment, '[^\x20\x09-\x0D]')),
sg as (select doc_id, segment, {grams.format(w="w")} as g, row_number() over () as sid from sw),
bg as (select sid, doc_id, len(g) as n, unnest(g) as gram from sg),
tb as (select *, {named} as named, count(*) filter ({named}) over (partition by tid) as n_named
  from (select tid, license, len(g) as n, unnest(g) as gram from tg)),
d as (
  select bg.sid, bg.doc_id, tb.license, tb.tid, 2.0::double * count(*) / (any_value(bg.n) + any_value(tb.n)) as dice
  from bg join tb using (gram) group by bg.sid, bg.doc_id, tb.license, tb.tid
  having dice >= {DICE_LEAST} and count(*) filter (tb.named) = any_value(tb.n_named)),
b as (select sid, doc_id, license, dice from d qualify row_number() over (partition by sid order by dice desc, license, tid) = 1),
r as (
  select doc_id, count(*) as n_matches, arg_max(license, (dice, -row_rank)) as license, max(dice) as dice,
    array_to_string(list_sort(list(distinct license)), ',') as licenses
  from (select *, dense_rank() over (order by license) as row_rank from b) group by doc_id)
select documents.doc_id, r.license, round(r.dice, 6) as dice, coalesce(r.licenses, '') as licenses,
  coalesce(r.n_matches, 0)::int as n_matches
from documents left join r on documents.doc_id = r.doc_id
"""


#: DuckDB SQL of op2.
SQL = _sql()
