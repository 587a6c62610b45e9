"""Licence scans on built-in functions: Dice coefficient over word bigrams, with bounds on size to prune templates.

Texts are compared in normal form: small letters and digits, single spaces, so line breaks and marks within a notice do
not matter. A stretch of n distinct bigrams can reach a Dice of t with a template of m only if
t / (2 - t) <= n / m <= (2 - t) / t, and then holds at least t / (2 - t) of the template's bigrams. So of any m + 1 minus
that many of them, it holds one: these, the longest, are the template's anchors. A text without any anchor is not looked
at further. At each anchor that a text holds, the stretch that the template would cover there is compared with it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlog.llm.common import discard, materialize
from driftlog.llm.quality import let, whole

# Notices by which works are commonly put under a licence, and the texts of short licences.
AS_IS = "The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software."
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
BSD_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
BSD_BINARY = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_NAME = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + AS_IS,
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", GPL.format("General Public License", 3)],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", GPL.format("General Public License", 2)],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3.", GPL.format("Lesser General Public License", 3)],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", GPL.format("Affero General Public License", 3)],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License.", f"{BSD} {BSD_SOURCE} {BSD_BINARY}"],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", f"{BSD} {BSD_SOURCE} {BSD_BINARY} {BSD_NAME}"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0."],
    "Proprietary": ["Copyright. All rights reserved.", "All rights reserved."],
}
ODD = "[^\\p{L}\\p{N}]+"


def normal_words(text: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


class Template:
    """rank: its place in the list; words; pairs: its distinct bigrams; anchors: bigram -> place of its first word."""

    def __init__(self, rank: int, license: str, text: str, threshold: float):
        w = normal_words(text)
        if len(w) < 2:
            raise ValueError(f"a template needs two words at least: {text!r}")
        self.rank, self.license, self.words = rank, license, w
        places: dict[str, int] = {}
        for i, p in enumerate(zip(w, w[1:])):
            places.setdefault(" ".join(p), i)
        self.pairs = list(places)
        least = math.ceil(threshold / (2 - threshold) * len(places) - 1e-9)
        rare = sorted(places, key=lambda p: (-len(p), p))[: len(places) - least + 1]
        self.anchors = {p: places[p] for p in rare}


def template_table(templates: dict[str, list[str]], threshold: float) -> list[Template]:
    """Longest first, as a shorter one may be another's beginning."""
    flat = sorted(((k, t) for k, ts in templates.items() for t in ts), key=lambda x: -len(normal_words(x[1])))
    return [Template(i, k, t, threshold) for i, (k, t) in enumerate(flat)]


def gate(known: list[Template]) -> str:
    """A pattern that finds any anchor in a text as it is written; alternatives branch by first letter, then first word."""
    by: dict[str, dict[str, set[str]]] = {}
    for p in {p for t in known for p in t.anchors}:
        a, b = p.split(" ")
        by.setdefault(a[0], {}).setdefault(a, set()).add(b)
    heads = []
    for c in sorted(by):
        tails = ["%s%s(?:%s)" % (a[1:], ODD, "|".join(sorted(by[c][a]))) for a in sorted(by[c])]
        heads.append(f"{c}(?:{'|'.join(tails)})")
    return f"(?iu)(?<![\\p{{L}}\\p{{N}}])(?:{'|'.join(heads)})(?![\\p{{L}}\\p{{N}}])"


def normal(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(c), ODD, " "), F.lit(" "))


def pairs(w: Column) -> Column:
    """Neighbouring words, joined by a space, in order."""
    return F.when(F.size(w) < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat(F.get(w, i), F.lit(" "), F.get(w, i + 1))))


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.8, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per row and licence found: doc_id, license, dice (rounded to 9 places), unit (normal form of the stretch).

    A licence is found where a stretch's Dice with one of its templates reaches threshold. A stretch is as long as its
    template and lies so that an anchor of both meets. Of stretches that overlap, only the best counts, so that CC BY and
    CC BY-NC are not both found in one notice: the greatest Dice, then the longest template, then the first in the text.
    Of a licence's stretches the best and then the first is returned. Null and empty texts have no licence, nor has
    an empty table; rows are judged one by one, repeated ones alike; other columns are not looked at. Time is linear in a
    text's length, and in the stretches that it holds.
    """
    known = template_table(templates or TEMPLATES, threshold)
    lo, hi = threshold / (2 - threshold), (2 - threshold) / threshold
    spots: dict[str, list[Column]] = {}
    for t in known:
        for p, j in t.anchors.items():
            spots.setdefault(p, []).append(F.struct(F.lit(t.rank).alias("t"), F.lit(j).alias("j")))
    at_anchor = F.create_map(*(x for p, s in spots.items() for x in (F.lit(p), F.array(*s))))
    cells = F.array(*(F.struct(F.lit(t.license).alias("license"), F.lit(len(t.words)).alias("n"), F.lit(len(t.pairs)).alias("m"), F.array(*map(F.lit, t.pairs)).alias("b")) for t in known))
    longest = max(len(t.words) for t in known)

    def stretches(w: Column) -> Column:
        marked = F.transform(pairs(w), lambda p, i: F.struct(i.alias("i"), p.alias("p")))
        held = F.filter(marked, lambda x: F.array_contains(F.array(*map(F.lit, spots)), x["p"]))
        # template and place as one number, as Spark tells numbers apart by hash but structs pair by pair
        one = lambda x, a: F.shiftleft(a["t"].cast("long"), 40) + x["i"] - a["j"] + longest
        places = F.flatten(F.transform(held, lambda x: F.transform(F.element_at(at_anchor, x["p"]), lambda a: one(x, a))))
        place = lambda k: F.struct(F.shiftright(k, 40).cast("int").alias("t"), (k.bitwiseAND(F.lit((1 << 40) - 1)) - longest).cast("int").alias("at"))
        start = lambda c: F.greatest(c["at"], F.lit(0))
        end = lambda c: F.least(c["at"] + F.get(cells, c["t"])["n"], F.size(w))
        cut = lambda c: F.struct(c["t"].alias("t"), start(c).alias("start"), end(c).alias("end"), F.slice(w, start(c) + 1, end(c) - start(c)).alias("u"))
        return F.transform(F.array_distinct(places), lambda k: let(place(k), cut))

    d = docs.select(F.col(doc_id).alias("doc_id"), whole(text).alias("_t")).where(F.rlike("_t", F.lit(gate(known))))
    d = d.select("doc_id", F.monotonically_increasing_id().alias("row"), let(F.split(normal(F.col("_t")), " "), stretches).alias("found"))
    u = d.select("doc_id", "row", F.explode("found").alias("f")).select("doc_id", "row", "f.*").withColumn("g", F.array_distinct(pairs(F.col("u"))))
    x = F.get(cells, F.col("t"))
    u = u.where((F.size("g") >= x["m"] * lo) & (F.size("g") <= x["m"] * hi))
    dice = F.round(2.0 * F.size(F.array_intersect("g", x["b"])) / (F.size("g") + x["m"]), 9)
    u = u.select("doc_id", "row", "t", "start", "end", x["license"].alias("license"), dice.alias("dice"), F.array_join("u", " ").alias("unit")).where(F.col("dice") >= threshold)
    u = materialize(u, "licences")
    # stretches that overlap share a block of words, and a block holds a bounded number of them
    block = lambda c: F.floor(c / longest)
    spread = u.select("row", "t", "start", "end", "dice", F.explode(F.sequence(block(F.col("start")), block(F.col("end") - 1))).alias("block"))
    a, b = spread.alias("a"), spread.alias("b")
    rank = lambda s: F.struct(-F.col(f"{s}.dice"), F.col(f"{s}.t"), F.col(f"{s}.start"))
    met = (F.col("a.start") < F.col("b.end")) & (F.col("b.start") < F.col("a.end")) & (rank("b") < rank("a"))
    beaten = a.join(b, (F.col("a.row") == F.col("b.row")) & (F.col("a.block") == F.col("b.block")) & met, "left_semi").select("row", "t", "start").distinct()
    best = u.join(beaten, ["row", "t", "start"], "left_anti")
    found = best.groupBy("doc_id", "row", "license").agg(F.max(F.struct("dice", (-F.col("start")).alias("at"), (-F.col("t")).alias("t"), "unit")).alias("b"))
    out = materialize(found.select("doc_id", "license", "b.dice", "b.unit"), "licences-found")
    discard(u)
    return out


def oracle(threshold: float = 0.8) -> str:
    known = template_table(TEMPLATES, threshold)
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    cells = ", ".join(f"({t.rank}, {quoted(t.license)}, {len(t.words)}, [{', '.join(map(quoted, t.pairs))}])" for t in known)
    anchors = ", ".join(f"({quoted(p)}, {t.rank}, {j})" for t in known for p, j in t.anchors.items())
    return rf"""
WITH templates(t, license, n, b) AS (VALUES {cells}),
anchors(p, t, j) AS (VALUES {anchors}),
d AS (SELECT row_number() OVER () AS rn, doc_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w FROM documents),
p AS (SELECT rn, unnest(range(1, len(w))) AS i, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS p FROM d),
h AS (SELECT DISTINCT rn, t, i - 1 - j AS spot FROM p JOIN anchors USING (p)),
u AS (SELECT rn, doc_id, h.t, license, b, greatest(spot, 0) AS a, least(spot + n, len(w)) AS e, w[greatest(spot, 0) + 1 : least(spot + n, len(w))] AS u
      FROM h JOIN d USING (rn) JOIN templates ON templates.t = h.t),
g AS (SELECT *, list_distinct(list_transform(range(1, len(u)), lambda i: u[i] || ' ' || u[i + 1])) AS g FROM u),
s AS (SELECT rn, doc_id, t, license, a, e, array_to_string(u, ' ') AS unit, round(2.0 * len(list_intersect(g, b)) / (len(g) + len(b)), 9)::DOUBLE AS dice FROM g
      WHERE len(g) BETWEEN len(b) * CAST({threshold} / {2 - threshold} AS DOUBLE) AND len(b) * CAST({2 - threshold} / {threshold} AS DOUBLE)),
f AS (SELECT * FROM s WHERE dice >= {threshold}),
best AS (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM f AS o WHERE o.rn = f.rn AND o.a < f.e AND f.a < o.e
         AND (o.dice > f.dice OR o.dice = f.dice AND (o.t < f.t OR o.t = f.t AND o.a < f.a))))
SELECT doc_id, license, dice, unit FROM best QUALIFY row_number() OVER (PARTITION BY rn, license ORDER BY dice DESC, a, t) = 1
"""


ORACLE = oracle()
