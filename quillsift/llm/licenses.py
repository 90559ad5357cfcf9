"""License scans: Dice coefficient over word bigrams against licence templates, in DataFrame functions only.

A unit (a line, or a paragraph of several lines) and a template are normalised alike: lower
case, every run of other characters than a-z and 0-9 a blank. A is the unit's set of word
bigrams (of one word, the word itself) and T the template's; they match if
2|A n T| / (|A| + |T|) reaches the threshold t. Size bounds prune before any set is compared:
|A| must lie between t/(2-t) |T| and (2-t)/t |T|; and as |A| is at most the number of words
and at least the number of distinct words less one, units outside every template's bounds get
no bigrams at all. Before that, texts and units without any of a few words go: a match has one of
them (`telling`). There is no shuffle but the final one by document and template.

Defined results: null and empty texts, and units without words, match nothing; a unit may match several
licences, and counts once for each; units of repeated rows count each; rows without id match as
one document without id;
an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = Fraction(4, 5)

#: Notices and headers by SPDX name; public texts, fixed values.
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    ],
    "GPL-3.0-only": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 3.",
    ],
    "GPL-3.0-or-later": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0-only": ["Licensed under the GNU General Public License, version 2."],
    "LGPL-3.0-only": ["Licensed under the GNU Lesser General Public License, version 3."],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Licensed under the BSD 3-Clause License.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "CC0-1.0": ["Released under CC0 1.0 Universal.", "Licensed under CC0 1.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
}


def template_bigrams(text: str) -> list[str]:
    words = re.sub(r"[^a-z0-9]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), text)).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)} or set(words))


def _bounds(size: int, t: Fraction) -> tuple[int, int]:
    return math.ceil(size * t / (2 - t)), math.floor(size * (2 - t) / t)


def telling(known: list[list[str]], t: Fraction) -> str:
    """A pattern found in every unit that matches one of the bigram sets: words, or bigrams of short ones, without which too few of the set's bigrams are left."""
    parts: set[str] = set()
    for bigrams in known:
        need = math.ceil(t * (_bounds(len(bigrams), t)[0] + len(bigrams)) / 2)
        while len(left := [b for b in bigrams if not any(p in b for p in parts)]) >= need:
            words = Counter(w for b in left for w in b.split() if len(w) >= 6)
            parts.add(max(words, key=lambda w: (words[w], len(w), w)) if words else max(left, key=lambda b: (len(b), b)))
    return "(?i)" + "|".join(sorted(p.replace(" ", "[^a-z0-9]+") for p in parts))


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def license_matches(docs: DataFrame, threshold: Fraction = THRESHOLD, templates: dict[str, list[str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document and licence found: id_col, license, dice (greatest of its units), n_units (lines and paragraphs that match)."""
    known = [(name, template_bigrams(text)) for name, texts in (templates or TEMPLATES).items() for text in texts]
    known = [(name, bigrams) for name, bigrams in known if bigrams]
    low, high = min((_bounds(len(b), threshold)[0] for _, b in known), default=1), max((_bounds(len(b), threshold)[1] for _, b in known), default=0)
    text = F.col(text_col).cast("string")
    paragraphs = F.filter(F.split("t", r"\n[ \t\r]*\n"), lambda p: F.contains(p, F.lit("\n")))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("t")).where(F.col("t").isNotNull())
    pattern = telling([b for _, b in known], threshold)
    rows = rows.where(F.col("t").rlike(pattern))
    rows = rows.select("id", F.explode(F.concat(F.split("t", "\n"), paragraphs)).alias("unit")).where(F.col("unit").rlike(pattern))
    words = F.split(F.trim(F.regexp_replace(_lower(F.col("unit")), "[^a-z0-9]+", " ")), " ")
    rows = rows.select("id", words.alias("w")).where((F.size("w") >= low) & (F.size("w") >= 1) & (F.element_at("w", 1) != ""))
    rows = rows.where(F.size(F.array_distinct("w")) - 1 <= high)
    pair = F.zip_with(F.expr("slice(w, 1, size(w) - 1)"), F.expr("slice(w, 2, size(w) - 1)"), lambda a, b: F.concat(a, F.lit(" "), b))
    rows = rows.select("id", F.array_distinct(F.when(F.size("w") > 1, pair).otherwise(F.col("w"))).alias("a"))
    rows = rows.withColumn("n", F.size("a"))
    scores: dict[str, list[Column]] = {}
    for name, bigrams in known:
        lo, hi = _bounds(len(bigrams), threshold)
        both, sizes = F.size(F.array_intersect("a", F.array(*[F.lit(b) for b in bigrams]))), F.col("n") + len(bigrams)
        reached = both * (2 * threshold.denominator) >= sizes * threshold.numerator
        scores.setdefault(name, []).append(F.when((F.col("n") >= lo) & (F.col("n") <= hi), F.when(reached, 2.0 * both / sizes)))
    best = [F.struct(F.lit(name).alias("license"), F.array_max(F.array(*s)).alias("dice")) for name, s in scores.items()]
    if not best:
        best = [F.struct(F.lit("").alias("license"), F.lit(None).cast("double").alias("dice"))]
    found = rows.select("id", F.explode(F.filter(F.array(*best), lambda m: m["dice"].isNotNull())).alias("m"))
    out = found.groupBy("id", "m.license").agg(F.max("m.dice").alias("dice"), F.count("*").alias("n_units"))
    return out.select(F.col("id").alias(id_col), "license", "dice", "n_units")
