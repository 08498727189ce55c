"""License scan by diagonal voting.

Every run of two neighbouring words of every text is hashed and joined with the places that the pair has in the
templates (license names and notices).  A hit votes for the diagonal `place in text - place in template`; votes are
summed by diagonal, and neighbouring diagonals (words left out or put in) are merged where the later one goes on in the
template behind the place at which the earlier one ended.  So a merged span holds distinct places of its template, in
order; it is verified by how many of them it holds.  Hash hits count only if the words themselves agree.

Only built-in functions; the template table is fixed, so its broadcast is bounded.  Defined results: null text has no
words; very long texts are read whole; of several spans the highest score counts, and all their labels; rows are told
apart by their place in the input, so repeated rows and null ids each get their own result row; an empty table gives an
empty result; other columns are not used.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Names whose consecutive words are counted, and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Wordings of common license notices, and their labels.
NOTICES = [
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-2.0"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("released under the mit license", "mit-notice"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit-notice"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("this work is licensed under a creative commons attribution", "cc-by"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("all rights reserved", "all-rights-reserved"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "apache-2.0"),
    ("this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose", "gpl"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "lgpl"),
    ("under the terms of the gnu affero general public license as published by the free software foundation", "agpl"),
    ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", "mit-notice"),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "mit-notice"),
    ("this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("this work is licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa-4.0"),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc-4.0"),
    ("to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "cc0"),
    ("this program and the accompanying materials are made available under the terms of the eclipse public license", "epl"),
    ("permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "bsl-1.0"),
    ("this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "zlib"),
]
#: Share of a notice's word pairs that a span must hold; diagonals this near are merged.
COVERAGE, BAND = 0.7, 3


def lower_ascii(text: Column) -> Column:
    """A-Z to lower case.  lower() does the same but for two letters whose lower case is or starts with an ASCII letter."""
    upper, small = "".join(map(chr, range(65, 91))), "".join(map(chr, range(97, 123)))
    return F.when(text.rlike("[İK]"), F.translate(text, upper, small)).otherwise(F.lower(text))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATOR), "")


def templates(spark: SparkSession) -> DataFrame:
    """A row per word pair of a template: template, label, is_base, pairs, place, word, next; one more row, template -1,
    that the end of every text meets."""
    rows = [(-1, None, False, 0, 0, "", "")]
    for i, (text, label, base) in enumerate([*((p, x, True) for p, x in PHRASES.items()), *((p, x, False) for p, x in NOTICES)]):
        w = re.sub("[^0-9a-z]+", " ", text).split()
        rows += [(i, label, base, len(w) - 1, j, *w[j : j + 2]) for j in range(len(w) - 1)]
    return spark.createDataFrame(rows, "template int, label string, is_base boolean, pairs int, place int, t_word string, t_next string").withColumn("h", F.xxhash64("t_word", "t_next"))


def votes(docs: DataFrame) -> DataFrame:
    """(row, doc_id, template, label, is_base, pairs, pos, place) of every verified hit; pos counts words from 0."""
    pair = lambda a, b: F.struct(F.xxhash64(a, b).alias("h"), a.alias("word"), b.alias("next"))
    words = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), words_of(F.col("text")).alias("w"))
    last = F.struct(F.xxhash64(F.lit(""), F.lit("")).alias("h"), F.lit("").alias("word"), F.lit("").alias("next"))
    pairs = F.concat(F.zip_with("w", F.slice("w", F.lit(2), F.greatest(F.size("w"), F.lit(1))), pair), F.array(last))
    each = words.select("row", "doc_id", F.posexplode_outer(pairs).alias("pos", "p")).select("row", "doc_id", "pos", "p.*")
    same = F.col("word").startswith(F.col("t_word")) & F.col("t_word").startswith(F.col("word")) & F.col("next").startswith(F.col("t_next")) & F.col("t_next").startswith(F.col("next"))
    return each.join(F.broadcast(templates(docs.sparkSession)), "h").filter(same).select("row", "doc_id", "template", "label", "is_base", "pairs", "pos", "place")


def spans(docs: DataFrame, coverage: float = COVERAGE, band: int = BAND) -> DataFrame:
    """A row per span found: row, doc_id, label, is_base, start and end word, score (share of the template's pairs); and
    a row per text with template -1, whose start is its number of words."""
    diagonal = votes(docs).groupBy("row", "doc_id", "template", "label", "is_base", "pairs", (F.col("pos") - F.col("place")).alias("diagonal"))
    voted = diagonal.agg(F.count("*").alias("n"), F.min("pos").alias("low"), F.max("pos").alias("high"))
    voted = voted.filter((F.col("n") >= F.least(F.lit(2), "pairs")) & (~F.col("is_base") | (F.col("n") == F.col("pairs"))))
    by = W.partitionBy("row", "template").orderBy("low", "diagonal")
    behind = lambda c: F.lag(c).over(by)
    goes_on = (F.abs(F.col("diagonal") - behind("diagonal")) <= band) & (F.col("low") - F.col("diagonal") > behind("high") - behind("diagonal"))
    apart = F.col("is_base") | (F.col("template") < 0) | ~F.coalesce(goes_on, F.lit(False))
    merged = voted.withColumn("group", F.sum(apart.cast("int")).over(by)).groupBy("row", "doc_id", "template", "label", "is_base", "pairs", "group")
    found = merged.agg(F.sum("n").alias("n"), F.min("low").alias("start"), (F.max("high") + 2).alias("end"))
    score = F.when(F.col("template") < 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.col("n") / F.col("pairs")))
    return found.withColumn("score", score).filter((F.col("template") < 0) | (F.col("score") >= coverage)).select("row", "doc_id", "template", "label", "is_base", "start", "end", "score")


def scan(docs: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """A row per row of `docs` (doc_id, text): n_words, n_base, first_word, last_word, base_labels, labels, score."""
    base = F.col("is_base")
    joined = lambda keep: F.array_join(F.array_sort(F.collect_set(F.when(keep, F.col("label")))), ",")
    place = F.when(base, F.col("start")).cast("long")
    return spans(docs, coverage).groupBy("row", "doc_id").agg(
        F.max(F.when(F.col("template") < 0, F.col("start"))).cast("long").alias("n_words"), F.count(place).alias("n_base"), F.min(place).alias("first_word"), F.max(place).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.col("template") >= 0).alias("labels"), F.max("score").alias("score"),
    ).drop("row")
