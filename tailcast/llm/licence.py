"""Licence scans by diagonal voting.

All rolling three-word grams of the texts are joined by hash to the positions of the
same grams in the templates; a hit, of which the words are compared, votes for its diagonal
(place in the text less place in the template), diagonals next to each other are merged, and
spans verified: how much of the template they hold, and that no other template fits the same words
better (licences of one family share most of their words).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tailcast.llm.common import lowered, saved, small_side

GRAM = 3
#: Words that may have been put in or left out of a notice in all: so many diagonals make one
#: span, which can't be longer than the notice by more.
SLACK = 8
#: Share of a notice's grams that a span must hold.
COVER = 0.7

# Phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Words of public licences and licence notices.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "apache-2",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-3",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation": "agpl",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation": "lgpl",
    "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at": "mpl-2",
    "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software": "unlicense",
    "to the extent possible under law the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide": "cc0",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc",
    "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license": "cc-by-nc-sa",
    "this work is licensed under a creative commons attribution noderivatives 4 0 international license": "cc-by-nd",
}


def words(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z; null as empty."""
    return F.array_remove(F.split(lowered(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def templates(spark: SparkSession, phrases: dict[str, str], notices: dict[str, str]) -> DataFrame:
    """(hash, gram, template, at, grams, exact, label): a row for each gram of each template, of any length."""
    rows = []
    for number, (text, label) in enumerate([*phrases.items(), *notices.items()]):
        w = text.split()
        if len(w) < GRAM:
            raise ValueError(f"a template has {GRAM} words or more: {text}")
        rows += [(" ".join(w[i : i + GRAM]), number, i, len(w) - GRAM + 1, number < len(phrases), label) for i in range(len(w) - GRAM + 1)]
    made = spark.createDataFrame(rows, "gram string, template int, at int, grams int, exact boolean, label string")
    return made.select(F.xxhash64("gram").alias("hash"), "*")


def spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", phrases: dict[str, str] | None = None, notices: dict[str, str] | None = None) -> DataFrame:
    """(row, doc_id, n_words, template, exact, label, first, last, cover), a row for each
    verified span (places of phrases in full, notices at COVER or more), and one with a
    null template for every row of ``docs``. Words count from 0, ``last`` included.

    A notice's span is the diagonals from one that was voted for to ``SLACK`` beyond, so that it is
    longer than the notice by no more, whatever else of the notice is repeated beside it.
    One scan, no shuffle of grams: hashes are held against those of the templates where they are
    made, and what passes is joined to the templates, by broadcast if these were counted to be few.
    """
    found = saved(templates(docs.sparkSession, PHRASES if phrases is None else phrases, NOTICES if notices is None else notices))
    w = F.col("w")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), words(F.col(text)).alias("w"))
    rows = rows.withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    # the parameter's own size, not the texts'
    ours = sorted({r["h"] for r in found.select(_gram_hash(F.transform(F.split("gram", " "), lambda x: F.xxhash64(x)), F.lit(0)).alias("h")).distinct().collect()})
    starts = F.when(F.size(w) >= GRAM, F.filter(F.sequence(F.lit(0), F.size(w) - GRAM), lambda i: _gram_hash(F.col("h"), i).isin(ours)))
    grams = F.transform(starts, lambda i: F.struct(i.alias("pos"), F.concat_ws(" ", F.slice(w, i + 1, GRAM)).alias("gram")))
    each = rows.select("row", "doc_id", F.size(w).cast("long").alias("n_words"), F.explode_outer(grams).alias("g")).select("row", "doc_id", "n_words", F.col("g.pos").alias("pos"), F.col("g.gram").alias("text_gram"))
    hit = each.join(small_side(found), (F.xxhash64("text_gram") == F.col("hash")) & (F.col("text_gram") == F.col("gram")), "left")

    named = ["row", "doc_id", "n_words", "template", "grams", "exact", "label"]
    voted = hit.groupBy(*named, (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.collect_set("at").alias("spots"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    beside = Window.partitionBy("row", "template").orderBy("diagonal").rangeBetween(Window.currentRow, SLACK)
    spots = F.when(F.col("exact"), F.col("spots")).otherwise(F.array_distinct(F.flatten(F.collect_list("spots").over(beside))))
    lo, hi = (F.when(F.col("exact"), F.col(c)).otherwise(f(c).over(beside)) for c, f in (("lo", F.min), ("hi", F.max)))
    merged = voted.select(*named, "diagonal", (F.size(spots) / F.col("grams")).alias("cover"), lo.alias("lo"), (hi + GRAM - 1).alias("hi"))
    # the fullest, then longest template's, then first
    value = F.struct("cover", "grams", (-F.col("template")).alias("t"), (-F.col("diagonal")).alias("d"))
    valued = merged.withColumn("value", value)
    # no span is longer than this, so whatever shares a word with one begins within it
    longest = max(len(t.split()) for t in (*(PHRASES if phrases is None else phrases), *(NOTICES if notices is None else notices), "")) + SLACK
    near = Window.partitionBy("row", "exact").orderBy("lo").rangeBetween(-longest, longest)
    judged = valued.withColumn("near", F.collect_list(F.when(F.col("cover") >= COVER, F.struct("lo", "hi", "value"))).over(near))
    hidden = F.exists("near", lambda x: (x["lo"] <= F.col("hi")) & (x["hi"] >= F.col("lo")) & (x["value"] > F.col("value")))
    judged = judged.withColumn("good", F.when(F.col("exact"), F.col("cover") == 1.0).otherwise((F.col("cover") >= COVER) & ~hidden))
    return judged.select("row", "doc_id", "n_words", *[F.when(F.col("good"), F.col(c)).alias(n) for c, n in (("template", "template"), ("exact", "exact"), ("label", "label"), ("lo", "first"), ("hi", "last"), ("cover", "cover"))])


def _gram_hash(hashes: Column, i: Column) -> Column:
    """Of the words at i, i + 1 and i + 2."""
    return F.xxhash64(*[F.get(hashes, i + k) for k in range(GRAM)])


def scanned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **tables: dict[str, str]) -> DataFrame:
    """One row for every row of ``docs``: doc_id, n_words, n_base (places of phrases),
    first_word and last_word (smallest and largest start of these; null without),
    base_labels, labels (notices' too; sorted, comma-joined, '' for none), score (largest
    share of a template that a span holds, 0 without).

    Null and empty texts have no words. Other columns are not read. Repeated rows, equal or null ids each give a row.
    """
    base = F.col("exact")
    labelled = spans(docs, doc_id, text, **tables).groupBy("row", "doc_id", "n_words").agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"),
        F.coalesce(F.max("cover"), F.lit(0.0)).alias("score"),
    )
    return labelled.drop("row")
