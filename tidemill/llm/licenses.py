"""License scans by diagonal voting, with DataFrame operations only.

Each document's rolling hashes of three words are joined to the places of the same three words in license templates;
a place's offset, document position less template position, is its diagonal. A copy of a template, however it is cut,
votes for one diagonal, and one with words put in or left out for neighbouring ones, which are merged. A merged run is
verified by the share of the template's places that it holds and by its length; of runs of different labels that overlap,
the one of the greatest share stays, as licenses resemble each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.llm.columns import ascii_lower, word_array
from tidemill.llm.store import cut

GRAM = 3
#: Phrases that count where they stand whole, and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Passages of license texts that count by votes, and their labels.
PASSAGES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "apache-2",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license": "lgpl",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "this work is licensed under a creative commons attribution": "cc-by",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
#: Diagonals this near are one run; the least share of a passage's places; the most words of a run per passage word.
NEAR, LEAST_SHARE, STRETCH = 3, 0.6, 1.5


def text_key(text: str) -> list[Column]:
    """h1, h2: two 64-bit hashes of a text. Each value's hash is seeded by the one before it, so a constant goes first:
    after the text it would only hash h1 once more."""
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]


def _grams(words: str) -> Column:
    """Elements (w0, w1, w2) of neighbouring words."""
    w = F.col(words)
    return F.arrays_zip(w.alias("w0"), F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))).alias("w1"), F.slice(w, F.lit(3), F.greatest(F.size(w) - 2, F.lit(0))).alias("w2"))


def _places(df: DataFrame, *keep: str) -> DataFrame:
    """keep, pos, gram, w0, w1, w2: a row for each run of three words."""
    return df.select(*keep, F.posexplode(_grams("words")).alias("pos", "g")).filter("g.w2 IS NOT NULL").select(*keep, F.col("pos").cast("long").alias("pos"), F.xxhash64("g.w0", "g.w1", "g.w2").alias("gram"), "g.w0", "g.w1", "g.w2")


def templates(spark: SparkSession, base: dict[str, str], passages: dict[str, str]) -> DataFrame:
    rows = [(t, label, is_base, text.split(" ")) for is_base, group in ((True, base), (False, passages)) for t, (text, label) in enumerate(group.items())]
    if short := [r for r in rows if len(r[3]) < GRAM]:
        raise ValueError(f"a template needs {GRAM} words: {short}")
    return spark.createDataFrame(rows, "template int, label string, is_base boolean, words array<string>")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] | None = None, passages: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and places: one row for each row of docs.

    Words are runs of 0-9, a-z, A-Z (without case) and characters beyond ASCII. n_base counts the places where a base
    phrase's words stand consecutively; first_word and last_word are the least and greatest word at which one starts,
    null if none does. labels adds those of passages. Labels are distinct, sorted, comma-joined. score is the greatest
    share of a template that was found, 1 for base phrases, 0 for none. places lists each (label, first_word, end_word).

    Null texts count as empty, with no words; texts of fewer than three words hold no template. Rows that repeat a
    doc_id each give a row; so do null doc_ids. Other columns aren't read.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    keyed = texts.select("doc_id", *text_key("text"), word_array(ascii_lower(F.col("text"))).alias("words"))
    key = ["h1", "h2"]
    kinds = templates(spark, BASE if base is None else base, PASSAGES if passages is None else passages).withColumn("length", F.size("words"))
    known = _places(kinds, "template", "label", "is_base", "length").withColumnRenamed("pos", "at")  # as large as the templates given
    votes = _places(keyed, *key).join(F.broadcast(known), ["gram", "w0", "w1", "w2"]).select(*key, "template", "label", "is_base", "length", "at", "pos", (F.col("pos") - F.col("at")).alias("diagonal"))
    votes = cut(votes.distinct(), "license-votes")  # copies of a text vote once
    per = [*key, "template", "label", "is_base", "length"]
    whole = votes.filter("is_base").groupBy(*per, "diagonal").agg(F.count("*").alias("n")).filter(F.col("n") == F.col("length") - GRAM + 1).select(*key, "label", "is_base", F.col("diagonal").alias("first_word"), (F.col("diagonal") + F.col("length")).alias("end_word"), F.lit(1.0).alias("share"))
    along = Window.partitionBy(*key, "template").orderBy("diagonal")
    tallied = votes.filter("NOT is_base").groupBy(*per, "diagonal").agg(F.collect_set("at").alias("at"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    runs = tallied.withColumn("new", (F.col("diagonal") - F.lag("diagonal").over(along) > NEAR).cast("int")).withColumn("run", F.sum(F.coalesce("new", F.lit(0))).over(along))
    merged = runs.groupBy(*per, "run").agg(F.size(F.array_distinct(F.flatten(F.collect_list("at")))).alias("n"), F.min("lo").alias("first_word"), (F.max("hi") + GRAM).alias("end_word"))
    kept = merged.withColumn("share", F.col("n") / (F.col("length") - GRAM + 1)).filter((F.col("share") >= LEAST_SHARE) & (F.col("end_word") - F.col("first_word") <= STRETCH * F.col("length"))).select(*key, "label", "is_base", "first_word", "end_word", "share")
    # passages resemble each other: of runs that overlap, those of another label and a greater share stay
    reach = int(STRETCH * max([len(t.split(" ")) for t in (PASSAGES if passages is None else passages)], default=0))
    near = Window.partitionBy(*key).orderBy("first_word").rangeBetween(-reach, reach)
    beside = kept.withColumn("near", F.collect_list(F.struct("label", "first_word", "end_word", "share")).over(near))  # a few for each word within reach
    better = F.exists("near", lambda x: (x["label"] != F.col("label")) & (x["share"] > F.col("share")) & (x["first_word"] < F.col("end_word")) & (F.col("first_word") < x["end_word"]))
    partial = beside.filter(~better).drop("near")
    found = whole.union(partial).groupBy(*key).agg(
        F.count_if("is_base").alias("n_base"),
        F.min(F.when(F.col("is_base"), F.col("first_word"))).alias("first_word"),
        F.max(F.when(F.col("is_base"), F.col("first_word"))).alias("last_word"),
        F.array_sort(F.collect_set(F.when(F.col("is_base"), F.col("label")))).alias("base_labels"),
        F.array_sort(F.collect_set("label")).alias("labels"),
        F.max("share").alias("score"),
        F.array_sort(F.collect_list(F.struct("first_word", "end_word", "label"))).alias("places"),
    )
    counted = keyed.select("doc_id", *key, F.size("words").cast("long").alias("n_words"))
    none = F.array().cast("array<struct<first_word: bigint, end_word: bigint, label: string>>")
    return counted.join(found, key, "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        F.coalesce(F.array_join("base_labels", ","), F.lit("")).alias("base_labels"), F.coalesce(F.array_join("labels", ","), F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("places", none).alias("places"),
    )
