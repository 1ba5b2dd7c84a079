"""License scans: lines, texts and passages that match licence templates by the Dice coefficient of their word bigrams.

scan() compares single lines and whole texts; passages() any run of words, so also notices that are wrapped over several
lines or stand within prose.

Built-in functions only. The templates are a fixed, short list; each is listed under all bigram counts that a match can
have, so that an equality join on the count prunes candidates before any bigrams are compared. A match has two thirds of a
template's bigrams (at 80 percent); so it contains one of a few words of the templates, and other units are passed over.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Short notices of public licences, as they are commonly written.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License.",
    "MIT permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def normalised(text: Column) -> Column:
    """The words of a text: A-Z lower-cased, runs of anything but a-z and 0-9 between them."""
    return F.split(F.trim(F.lower(F.regexp_replace(text, "[^A-Za-z0-9]+", " "))), " ")


def pairs(words: Column) -> Column:
    """Pairs of neighbouring words, in order; none for fewer than two words."""
    # no lambda refers to the words as a whole: the optimizer would put their making into each call
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b))


def bigrams(words: Column) -> Column:
    """Distinct pairs of neighbouring words; none for fewer than two words."""
    return F.array_distinct(pairs(words))


def templates(spark: SparkSession, texts: dict[str, str] = TEMPLATES, percent: int = 80) -> DataFrame:
    """license, its bigrams, their number, and n: a row for each bigram count that a Dice coefficient of percent/100 allows.

    2 |A n B| / (|A| + |B|) is at most 2 min / (|A| + |B|), so a match's count is from p / (200 - p) to (200 - p) / p times
    the template's.
    """
    rows = spark.createDataFrame(list(texts.items()), "license string, text string").select("license", bigrams(normalised(F.col("text"))).alias("grams"))
    rows = rows.withColumn("m", F.size("grams")).filter("m > 0")
    low = F.ceil(F.col("m") * percent / (200 - percent)).cast("int")
    high = F.floor(F.col("m") * (200 - percent) / percent).cast("int")
    return rows.select("license", "grams", "m", F.explode(F.sequence(low, high)).alias("n"))


def _pairs_of(text: str) -> set[tuple[str, str]]:
    words = re.sub("[^a-z0-9]+", " ", text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))).split()
    return set(zip(words, words[1:], strict=False))


def telling_words(texts: dict[str, str] = TEMPLATES, percent: int = 80) -> list[str]:
    """Words of which every match of a template contains one.

    A match shares i bigrams with i >= p/200 (i + m), so it lacks at most m - p m / (200 - p) of the template's m. Words are
    picked until of each template more bigrams than that hold a picked word: long words first, which other texts rarely
    have, shorter ones only where these don't suffice.
    """
    left = {}
    for name, text in texts.items():
        grams = _pairs_of(text)
        if grams:
            left[name] = grams, len(grams) - -(-percent * len(grams) // (200 - percent)) + 1
    picked: list[str] = []
    for least in (7, 6, 5, 4, 1):
        while left:
            gain: dict[str, int] = {}
            for grams, need in left.values():
                for w in {w for g in grams for w in g if len(w) >= least}:
                    gain[w] = gain.get(w, 0) + min(need, sum(w in g for g in grams))
            if not gain:
                break
            word = max(gain, key=lambda w: (gain[w], len(w), w))
            picked.append(word)
            for name, (grams, need) in list(left.items()):
                met = {g for g in grams if word in g}
                left[name] = grams - met, need - len(met)
                if need <= len(met):
                    del left[name]
    return picked


def has_telling(text: Column, words: list[str]) -> Column:
    """Whether a text has one of the words, A-Z as a-z, between anything but letters a-z and digits.

    One pattern, tried where words begin: a test for each word would lower-case the text anew for each.
    """
    return F.rlike(text, F.lit(f"(?i)(?<![a-z0-9])(?:{'|'.join(words)})(?![a-z0-9])")) if words else F.lit(False)


def scan(docs: DataFrame, texts: dict[str, str] = TEMPLATES, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Matches: `key`, unit (a line's number from 0; -1: the whole text of several lines), license and dice.

    texts: a short list of templates. Each unit may match several of them; null and empty texts match none.
    """
    found, telling = templates(docs.sparkSession, texts, percent), telling_words(texts, percent)
    bounds = found.agg(F.min("n"), F.max("n")).first()
    if bounds[0] is None:
        return docs.select(key, F.lit(0).alias("unit"), F.lit("").alias("license"), F.lit(0.0).alias("dice")).limit(0)
    low, high = int(bounds[0]), int(bounds[1])
    lines = F.split("_text", "\n", -1)
    docs = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).filter(has_telling(F.col("_text"), telling))
    docs = docs.withColumn("_whole", F.when(F.contains("_text", F.lit("\n")), F.size(lines)).otherwise(-1))
    parts = F.when(F.col("_whole") > 0, F.concat(lines, F.array("_text"))).otherwise(lines)
    units = docs.select("_key", "_whole", F.posexplode(parts).alias("unit", "part")).filter(has_telling(F.col("part"), telling))
    units = units.withColumn("unit", F.when(F.col("unit") == F.col("_whole"), -1).otherwise(F.col("unit")))
    # explode() of one element keeps the optimizer from putting the making of words and bigrams into every later use
    words = units.select("_key", "unit", F.explode(F.array(normalised(F.col("part")))).alias("words")).filter(F.size("words") > low)
    counted = words.select("_key", "unit", F.explode(F.array(bigrams(F.col("words")))).alias("own")).withColumn("n", F.size("own")).filter(F.col("n").between(low, high))
    both = counted.join(F.broadcast(found), "n").withColumn("same", F.size(F.array_intersect("own", "grams")))
    hits = both.filter(200 * F.col("same") >= percent * (F.col("n") + F.col("m")))
    return hits.select(F.col("_key").alias(key), "unit", "license", F.round(2 * F.col("same") / (F.col("n") + F.col("m")), 6).alias("dice"))


def _let(value: Column, use) -> Column:
    """use(value), with the value made once: lambdas see it as a variable."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _run(own: Column, at: Column, grams: Column, spare: Column, lengths: list[Column]) -> Column:
    """The bigrams from `at` until its bigram comes again, or far enough that more than `spare` foreign ones are among them."""
    part = F.slice(own, at, lengths[0])
    if len(lengths) == 1:
        return _let(part, lambda s: _let(F.array_position(F.slice(s, F.lit(2), F.size(s)), F.get(s, F.lit(0))), lambda q: F.when(q > 0, F.slice(s, F.lit(1), q.cast("int"))).otherwise(s)))

    def cut(s: Column) -> Column:
        again = F.array_position(F.slice(s, F.lit(2), F.size(s)), F.get(s, F.lit(0)))
        longer = F.when(F.size(F.array_except(s, grams)) > spare, s).otherwise(_run(own, at, grams, spare, lengths[1:]))
        return _let(again, lambda q: F.when(q > 0, F.slice(s, F.lit(1), q.cast("int"))).otherwise(longer))

    return _let(part, cut)


def _windows(own: Column, hits: Column, t: Column, percent: int) -> Column:
    """All windows of a document's bigrams that match template t and that no window within beats: -dice, words, first.

    A window that doesn't begin and end with a bigram of the template, or whose first bigram comes again, or whose last one
    came before, holds a shorter one of no lower Dice; these are left out.
    """
    none = F.array().cast("array<struct<loss:double,words:int,first:int>>")

    def ends(at: Column, s: Column, distinct: Column, same: Column) -> Column:
        # the i-th of the template's bigrams, at place j of the distinct ones, ends a window with i of j in common
        places = F.transform(same, lambda x, i: F.struct((i + 1).alias("i"), F.array_position(distinct, x).cast("int").alias("j"), F.array_position(s, x).cast("int").alias("n")))
        good = F.filter(places, lambda x: 200 * x["i"] >= percent * (x["j"] + t["m"]))
        return F.transform(good, lambda x: F.struct((-2 * x["i"] / (x["j"] + t["m"])).alias("loss"), (x["n"] + 1).alias("words"), (at - 1).alias("first")))

    def begun(at: Column) -> Column:
        run = _run(own, at, t["grams"], t["spare"], [4 * t["m"], 64 * t["m"], F.size(own)])
        return _let(run, lambda s: _let(F.array_distinct(s), lambda d: _let(F.array_intersect(d, t["grams"]), lambda x: F.when(F.size(x) >= t["need"], ends(at, s, d, x)).otherwise(none))))

    return F.flatten(F.transform(F.filter(hits, lambda p: F.array_contains(t["grams"], F.element_at(own, p))), begun))


def passages(docs: DataFrame, texts: dict[str, str] = TEMPLATES, percent: int = 80, text: str = "text") -> DataFrame:
    """docs with `passages`: the runs of words, over any lines, that match a template, as (first, words, license, dice).

    first is the number of the run's first word from 0, among the runs of a-z, A-Z and 0-9 of the whole text. Of a
    template's matches the one with the greatest Dice comes first, then the shortest, then the first; others that share a
    word with it go, and so on with the rest. Null and empty texts have none. Rows, repeated ones and those with null ids too,
    stay as they are but for a column of that name, which gives way; nothing is shuffled.
    """
    kind = "array<struct<first:int,words:int,license:string,dice:double>>"
    known = {k: sorted(" ".join(g) for g in grams) for k, v in texts.items() if (grams := _pairs_of(v))}
    if not known:
        return docs.withColumn("passages", F.array().cast(kind))
    # a match has `need` of the template's bigrams and no more than `spare` others
    listed = F.array(*(F.struct(F.lit(k).alias("license"), F.array(*map(F.lit, g)).alias("grams"), F.lit(len(g)).alias("m"), F.lit(-(-percent * len(g) // (200 - percent))).alias("need"), F.lit(len(g) * (200 - 2 * percent) // percent).alias("spare")) for k, g in sorted(known.items())))
    every = sorted({g for x in known.values() for g in x})

    def greedy(t: Column, windows: Column) -> Column:
        apart = lambda a, b: (a["first"] + a["words"] <= b["first"]) | (b["first"] + b["words"] <= a["first"])
        taken = F.aggregate(F.sort_array(windows), F.array().cast("array<struct<loss:double,words:int,first:int>>"), lambda acc, w: F.when(F.forall(acc, lambda a: apart(a, w)), F.concat(acc, F.array(w))).otherwise(acc))
        return F.transform(taken, lambda w: F.struct(w["first"].alias("first"), w["words"].alias("words"), t["license"].alias("license"), F.round(-w["loss"], 6).alias("dice")))

    def within(own: Column) -> Column:
        hits = F.filter(F.transform(own, lambda x, i: F.when(x.isin(every), i + 1)), lambda p: p.isNotNull())
        near = lambda have: F.filter(listed, lambda t: F.size(F.array_intersect(t["grams"], have)) >= t["need"])
        some = _let(F.array_distinct(F.filter(own, lambda x: x.isin(every))), near)
        return _let(hits, lambda h: F.flatten(F.transform(some, lambda t: greedy(t, _windows(own, h, t, percent)))))

    out = F.sort_array(_let(pairs(F.col("_words")), within))
    # words are made once, before any lambda
    words = F.when(has_telling(F.col(text), telling_words(texts, percent)), normalised(F.col(text)))
    kept = [c for c in docs.columns if c != "passages"]
    table = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("_row"), words.alias("_words"))
    table = table.select("_row", F.coalesce(out, F.array()).cast(kind).alias("_found"))
    return table.select(*(F.col("_row").getField(c).alias(c) for c in kept), F.col("_found").alias("passages"))


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op1_license_passages(spark, sf_dir: str) -> DataFrame:
    return passages(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", "passages")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_NORMAL = "string_split(trim(regexp_replace(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g')), ' ')"
_GRAMS = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
OP1_SQL = f"""
WITH t AS (
  SELECT license, {_GRAMS} AS grams FROM (SELECT license, {_NORMAL.format("text")} AS w
  FROM (VALUES {", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in TEMPLATES.items())}) AS v(license, text))),
u AS (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS unit, unnest(string_split(text, chr(10))) AS part FROM documents
  UNION ALL SELECT doc_id, -1, text FROM documents WHERE contains(text, chr(10))),
g AS (SELECT doc_id, unit, {_GRAMS} AS own FROM (SELECT doc_id, unit, {_NORMAL.format("part")} AS w FROM u)),
m AS (
  SELECT doc_id, unit, license, len(list_intersect(own, grams)) AS same, len(own) + len(grams) AS total FROM g, t
  WHERE 5 * len(own) >= 3 * len(grams) AND 5 * len(grams) >= 3 * len(own))
SELECT doc_id, unit::INTEGER AS unit, license, round(2.0::DOUBLE * same / total, 6) AS dice FROM m WHERE 200 * same >= 80 * total
"""
