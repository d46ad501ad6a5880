"""License scans, in DataFrame functions only.

Texts and templates are normalised (A-Z lower-cased, anything but letters, digits and dots between digits a blank) and
compared by the Dice coefficient of their sets of word bigrams. Compared are the lines of a text and its paragraphs (runs
of lines between blank ones) of several lines. A template of n bigrams can only reach the threshold t with a unit of
n t / (2 - t) to n (2 - t) / t bigrams, and such a unit holds n t / (2 - t) of its bigrams at least. So a few words, chosen from the
templates, must be in any matching text: texts and units without them are ruled out first. Units outside the bounds of all
templates are dropped before their bigrams are listed, and each bigram meets only templates whose bounds its unit is in.

`passages` finds templates wherever they stand: any stretch of consecutive words of a text is compared, whatever lines and
paragraphs it runs over or lies in. Trimming a stretch at an end to the next bigram of the template never lowers its
score, and so does ending it where a new bigram of the template comes up; so the stretches from each bigram of the
template to each later one are all that matter, up to n (2 - t) / t distinct bigrams.

Templates are a small table by nature; its rows are checked against MAX_TEMPLATE_BIGRAMS before it may be broadcast.

Defined cases: null and empty texts have no units; units and templates of one word have the one-word gram; equal scores of
a unit go to the template of smaller id; rows of equal id are told apart by their text and give equal rows once; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

THRESHOLD = 0.8
MAX_TEMPLATE_BIGRAMS = 200_000

# Fixed texts: notices and short licenses as they are commonly written.
TEMPLATES = {
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
        "specific language governing permissions and limitations under the License."
    ),
    "MIT-notice": "Released under the MIT License.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
        "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION "
        "OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE "
        "IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
        "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER "
        "IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
        "PERFORMANCE OF THIS SOFTWARE."
    ),
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
        "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public "
        "License for more details."
    ),
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0-notice": "This work is dedicated to the public domain under CC0 1.0.",
    "BSD-3-Clause-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "MPL-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "all-rights-reserved": "All rights reserved.",
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normal_words(text: Column) -> Column:
    """Words of the normalised text."""
    plain = F.regexp_replace(F.translate(text, UPPER, LOWER), r"(?:[^\p{L}\p{N}.]|(?<![0-9])\.|\.(?![0-9]))+", " ")
    return F.filter(F.split(F.trim(plain), " "), lambda w: w != "")


def bigrams_in_order(words: Column) -> Column:
    """Pairs of neighbouring words; a single word is its own gram, no words give none."""
    pairs = F.arrays_zip(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(1))).alias("x"), F.slice(words, 2, F.size(words)).alias("y"))
    return F.transform(pairs, lambda p: F.concat_ws(" ", p["x"], p["y"]))


def bigrams(words: Column) -> Column:
    """Distinct pairs of neighbouring words."""
    return F.array_distinct(bigrams_in_order(words))


def template_grams(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """One row per template bigram: license, gram, size (bigrams of the template)."""
    table = spark.createDataFrame(sorted(templates.items()), "license string, text string")
    sized = table.select("license", normal_words(F.col("text")).alias("words")).withColumn("grams", bigrams(F.col("words")))
    sized = sized.withColumn("size", F.size("grams"))
    return sized.select("license", "size", F.explode("grams").alias("gram"))


def signature(grams: list[Row], reach: float) -> list[str]:
    """Words of which every unit within the threshold of a template holds at least one.

    Such a unit has at least size / reach of the template's bigrams, so it misses fewer than are left. Words are taken,
    those in most bigrams not covered yet first and long ones before short ones, until they cover more than that.
    """
    templates: dict[str, list[str]] = {}
    for row in grams:
        templates.setdefault(row.license, []).append(row.gram)
    chosen: set[str] = set()
    for _, own in sorted(templates.items()):
        may_miss = len(own) * (1 - 1 / reach) + 1e-9
        open_ = [set(g.split(" ")) for g in own]
        open_ = [g for g in open_ if not g & chosen]
        while open_ and len(own) - len(open_) <= may_miss:
            words = sorted(set().union(*open_))
            best = max(words, key=lambda w: (sum(w in g for g in open_) * min(len(w), 8) ** 2, w))
            chosen.add(best)
            open_ = [g for g in open_ if best not in g]
    return sorted(chosen)


def checked(grams: DataFrame) -> tuple[int | None, int | None]:
    """Sizes of the smallest and largest template, if the table is small enough for every task."""
    count, smallest, largest = grams.agg(F.count("*"), F.min("size"), F.max("size")).first()
    if count > MAX_TEMPLATE_BIGRAMS:
        raise ValueError(f"{count} template bigrams; at most {MAX_TEMPLATE_BIGRAMS} are sent to every task")
    return smallest, largest


def signature_pattern(grams: DataFrame, reach: float) -> str:
    words = "|".join(rf"\Q{w}\E" for w in signature(grams.collect(), reach))
    return rf"(?i)(?<![\p{{L}}\p{{N}}])(?:{words})(?![\p{{L}}\p{{N}}])"


def scan(
    docs: DataFrame,
    templates: dict[str, str] | None = None,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Every unit of a text within the threshold of a template.

    Columns: the id, unit ("line" or "paragraph"), nth (its number in the text, from 1), license (the best template),
    dice. A paragraph of a single line is left out, as the line says the same.
    """
    grams = template_grams(docs.sparkSession, templates or TEMPLATES)
    smallest, largest = checked(grams)
    reach = (2 - threshold) / threshold
    # Only texts, and then units, with a word of the signature can match: one pass over the text rules out the others.
    some_word = signature_pattern(grams, reach)
    text = F.coalesce(F.col(text_col), F.lit(""))
    numbered = lambda parts, unit: F.transform(
        parts, lambda part, i: F.struct(F.lit(unit).alias("unit"), (i + 1).alias("nth"), part.alias("part"))
    )
    lines = numbered(F.split(text, "\n"), "line")
    paragraphs = F.filter(
        numbered(F.split(text, r"\n(?:[ \t\r]*\n)+"), "paragraph"), lambda p: F.trim(p["part"], F.lit("\n")).contains("\n")
    )
    units = (
        docs.where(text.rlike(some_word))
        .select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row"), F.inline(F.concat(lines, paragraphs)))
        .where(F.col("part").rlike(some_word))
        .select("id", "row", "unit", "nth", normal_words(F.col("part")).alias("words"))
        .select("id", "row", "unit", "nth", bigrams(F.col("words")).alias("grams"))
        .withColumn("n", F.size("grams"))
        .where(F.col("n").between((smallest or 0) / reach, (largest or 0) * reach))
    )
    rows = units.select("id", "row", "unit", "nth", "n", F.explode("grams").alias("gram"))
    near = (F.col("n") >= F.col("size") / reach) & (F.col("n") <= F.col("size") * reach)
    shared = (
        rows.join(F.broadcast(grams), "gram")
        .where(near)
        .groupBy("id", "row", "unit", "nth", "n", "license", "size")
        .agg(F.count_distinct("gram").alias("shared"))
        .withColumn("dice", 2 * F.col("shared") / (F.col("n") + F.col("size")))
        .where(F.col("dice") >= threshold)
    )
    best = shared.groupBy("id", "row", "unit", "nth").agg(
        F.min(F.struct((-F.col("dice")).alias("minus"), "license")).alias("best")
    )
    return best.select(
        F.col("id").alias(id_col), "unit", "nth", F.col("best.license").alias("license"), (-F.col("best.minus")).alias("dice")
    )


def passages(
    docs: DataFrame,
    templates: dict[str, str] | None = None,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Every template in a text, as the stretches of words within its threshold.

    Columns: the id, license, first_word and last_word (numbers of words of the normalised text, from 1), dice. Stretches of
    one template that overlap are the same find: the best goes first, then the shortest, then the earliest, and what
    overlaps it is left out. Templates do not displace each other.
    """
    grams = template_grams(docs.sparkSession, templates or TEMPLATES)
    checked(grams)
    reach = (2 - threshold) / threshold
    some_word = signature_pattern(grams, reach)
    wanted = grams.groupBy("license", "size").agg(F.collect_list("gram").alias("wanted"))
    wanted = wanted.withColumn("step", F.when(F.element_at("wanted", 1).contains(" "), 1).otherwise(0))
    texts = (
        docs.where(F.coalesce(F.col(text_col), F.lit("")).rlike(some_word))
        .select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row"), normal_words(F.col(text_col)).alias("words"))
        .select("id", "row", F.explode(F.array(F.struct("words", bigrams_in_order(F.col("words")).alias("pairs")))).alias("own"))
        .select("id", "row", "own.words", "own.pairs")
    )
    # A template of one word is looked for among the words themselves.
    at = F.when(F.col("step") == 0, F.col("words")).otherwise(F.col("pairs"))
    held = texts.join(
        F.broadcast(wanted), F.size(F.array_intersect(at, F.col("wanted"))) >= F.col("size") / reach - 1e-9
    ).withColumn("at", at)
    begun = held.select(
        "id", "row", "license", "size", "wanted", "step", "at",
        F.explode(
            F.filter(F.sequence(F.lit(1), F.size("at")), lambda p: F.array_contains(F.col("wanted"), F.element_at(F.col("at"), p)))
        ).alias("first"),
    )
    # Distinct grams from there on, in the order of their first places: the i-th ends a stretch of i distinct grams. A
    # window of twice the bound holds enough of them, unless the text repeats itself; then the rest of the text is taken.
    most = F.floor(F.col("size") * reach + 1e-9).cast("int")
    window = F.slice("at", F.col("first"), 2 * F.col("most"))
    near, rest = F.array_distinct(window), F.array_distinct(F.slice("at", F.col("first"), F.size("at")))
    ahead = begun.withColumn("most", most).withColumn(
        "ahead", F.slice(F.when(F.size(near) >= F.col("most"), near).otherwise(rest), 1, F.col("most"))
    )
    hits = ahead.withColumn("hit", F.filter(F.sequence(F.lit(1), F.size("ahead")), lambda i: F.array_contains(F.col("wanted"), F.element_at(F.col("ahead"), i))))
    ends = hits.select(
        "id", "row", "license", "size", "step", "at", "ahead", "first", F.posexplode("hit").alias("before", "n")
    ).withColumn("dice", 2.0 * (F.col("before") + 1) / (F.col("n") + F.col("size")))
    last = F.col("first") - 1 + F.array_position(F.slice("at", F.col("first"), F.size("at")), F.element_at("ahead", F.col("n")))
    found = (
        ends.where(F.col("dice") >= threshold)
        .select("id", "row", "license", "dice", "first", (last + F.col("step")).cast("int").alias("last"))
        .groupBy("id", "row", "license")
        .agg(
            F.array_sort(
                F.collect_set(F.struct((-F.col("dice")).alias("minus"), (F.col("last") - F.col("first")).alias("long"), "first", "last"))
            ).alias("found")
        )
    )
    none = F.slice("found", 1, 0)
    apart = F.aggregate(
        "found",
        none,
        lambda kept, x: F.when(
            F.exists(kept, lambda k: (k["first"] <= x["last"]) & (x["first"] <= k["last"])), kept
        ).otherwise(F.concat(kept, F.array(x))),
    )
    return found.select("id", "license", F.inline(apart)).select(
        F.col("id").alias(id_col), "license", F.col("first").alias("first_word"), F.col("last").alias("last_word"), (-F.col("minus")).alias("dice")
    )
