"""Licence notices by diagonal voting; everything is built from column expressions.

1. Every rolling hash of ``K`` words of every text is joined to the positions of
   the templates that have it; a hit also compares the words themselves.
2. A hit votes for its diagonal, text position minus template position.  Votes are
   sets of template positions, so copies of a text, which are one text here, vote once.
3. A phrase stands where one diagonal has the votes of all its positions.
4. A notice may have words added or left out, which moves the diagonal: the diagonals
   within a quarter of the template's length around a leading one are merged.
5. A merged span is verified by the words it shares with the template, counted on
   the side that shares fewer, over the longer of span and template: its score.
   Spans of ``SCORE`` or more stay; where spans overlap, the best one does.

A word is ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from utterset.session import Scratch

K = 3  # words of a rolling hash: no template may be shorter
SCORE = 0.8
BROADCAST_POSITIONS = 1_000_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Template(NamedTuple):
    label: str
    text: str


GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as "
    "published by the Free Software Foundation, either version {} of the License, or (at your option) any later version"
)
CREATIVE = "This work is licensed under a Creative Commons {} 4.0 International License"

#: Fixed wording of well-known notices; texts and labels may be replaced by any others.
NOTICES = (
    Template("mit", "Released under the MIT License"),
    Template("mit", "Licensed under the MIT License"),
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so",
    ),
    Template("apache-2", "Licensed under the Apache License, Version 2.0"),
    Template(
        "apache-2",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at",
    ),
    Template("gpl-2", "Licensed under the GNU General Public License, version 2"),
    Template("gpl-3", "Licensed under the GNU General Public License, version 3"),
    Template("gpl-2", GNU.format("General Public License", 2)),
    Template("gpl-3", GNU.format("General Public License", 3)),
    Template("lgpl-3", GNU.format("Lesser General Public License", 3)),
    Template("agpl-3", GNU.format("Affero General Public License", 3)),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
    ),
    Template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies",
    ),
    Template("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    Template("cc-by", "Licensed under CC BY 4.0"),
    Template("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    Template("cc-by", CREATIVE.format("Attribution")),
    Template("cc-by-sa", CREATIVE.format("Attribution-ShareAlike")),
    Template("cc-by-nc", CREATIVE.format("Attribution-NonCommercial")),
    Template("unlicense", "This is free and unencumbered software released into the public domain"),
)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(f"({WORD})"), F.lit(1))


def _grams(words: Column) -> Column:
    """Hash of each run of ``K`` words."""
    runs = F.size(words) - F.lit(K - 1)
    none = F.array().cast("array<bigint>")
    return F.when(
        runs > 0, F.transform(F.sequence(F.lit(1), runs), lambda i: F.xxhash64(F.slice(words, i, K)))
    ).otherwise(none)


def template_table(spark: SparkSession, phrases: Sequence[Template], notices: Sequence[Template]) -> DataFrame:
    """(template, label, phrase, n_template, tokens); a template of fewer than ``K`` words raises."""
    rows = [(i, t.label, i < len(phrases), t.text) for i, t in enumerate([*phrases, *notices])]
    table = spark.createDataFrame(rows, "template int, label string, phrase boolean, text string")
    table = table.withColumn("tokens", words_of(F.col("text"))).withColumn("n_template", F.size("tokens")).drop("text")
    if short := [r["label"] for r in table.where(F.col("n_template") < K).collect()]:
        raise ValueError(f"templates of fewer than {K} words: {short}")
    return table


def _text_keys(text: Column) -> list[Column]:
    """128 bits that tell texts apart."""
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("text"), text).alias("t2")]


def hits(docs: DataFrame, templates: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(t1, t2, place, template, at) for each hit, and a row with place -1, doc_id and n_words for each document."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    read = docs.select(F.col(doc_id).alias("doc_id"), *_text_keys(body), words_of(body).alias("words"))
    # the first entry stands for the document itself and meets no template
    keys = F.concat(F.array(F.lit(None).cast("bigint")), _grams(F.col("words")))
    laid = read.select("doc_id", "t1", "t2", "words", F.posexplode(keys).alias("place", "key"))
    spots = templates.select(
        "template", "tokens", F.posexplode(_grams(F.col("tokens"))).alias("at", "spot")
    ).select("template", "at", "spot", F.slice("tokens", F.col("at") + 1, K).alias("gram"))
    n_words = F.when(F.col("place") == 0, F.size("words").cast("long"))
    own = F.slice("words", F.greatest("place", F.lit(1)), K)
    if (templates.agg(F.sum("n_template")).first()[0] or 0) <= BROADCAST_POSITIONS:
        met = laid.join(F.broadcast(spots), (F.col("key") == F.col("spot")) & (own == F.col("gram")), "left")
        met = met.withColumn("n_words", n_words)
    else:
        narrow = laid.select("doc_id", "t1", "t2", "place", "key", own.alias("own"), n_words.alias("n_words"))
        met = narrow.join(spots, (F.col("key") == F.col("spot")) & (F.col("own") == F.col("gram")), "left")
    return met.where("place = 0 or template is not null").select(
        F.when(F.col("place") == 0, F.col("doc_id")).alias("doc_id"), "n_words", "t1", "t2",
        (F.col("place") - 1).alias("place"), "template", "at",
    )


def diagonals(found: DataFrame) -> DataFrame:
    """(t1, t2, template, diagonal, ats): the template positions that voted for each diagonal."""
    voted = found.where("template is not null").withColumn("diagonal", F.col("place") - F.col("at"))
    return voted.groupBy("t1", "t2", "template", "diagonal").agg(F.collect_set("at").alias("ats"))


def phrase_places(votes: DataFrame, templates: DataFrame) -> DataFrame:
    """(t1, t2, label, place): where a phrase's words stand consecutively."""
    named = votes.join(F.broadcast(templates.where("phrase").drop("tokens")), "template")
    whole = named.where(F.size("ats") == F.col("n_template") - (K - 1))
    return whole.select("t1", "t2", "label", F.col("diagonal").alias("place"))


def _covered(starts: Column) -> Column:
    """Words inside runs of ``K`` words at the given places."""
    return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda a: F.sequence(a, a + (K - 1))))))


def notice_spans(votes: DataFrame, templates: DataFrame, longest: int, score: float = SCORE) -> DataFrame:
    """(t1, t2, label, template, first, last, score): verified spans, the best where they overlap.

    ``longest`` is the number of words of the longest notice.  Windows hold the
    diagonals of one text and template, and slide over a bounded frame.
    """
    drift = F.floor(F.col("n_template") / 4)
    named = votes.join(F.broadcast(templates.where("not phrase").drop("tokens")), "template")
    near = Window.partitionBy("t1", "t2", "template").orderBy("diagonal").rangeBetween(-(longest // 4), longest // 4)
    merged = named.withColumn("around", F.collect_list(F.struct("diagonal", "ats")).over(near)).withColumn(
        "around", F.filter("around", lambda x: F.abs(x["diagonal"] - F.col("diagonal")) <= drift)
    )
    votes_here = F.size("ats")

    def leads(x: Column) -> Column:
        more = F.size(x["ats"])
        return (more > votes_here) | ((more == votes_here) & (x["diagonal"] < F.col("diagonal")))

    lead = merged.where(~F.exists("around", leads))
    spans = lead.select(
        "t1", "t2", "label", "template", "n_template",
        F.array_distinct(F.flatten(F.transform("around", lambda x: x["ats"]))).alias("ats"),
        F.array_distinct(
            F.flatten(F.transform("around", lambda x: F.transform(x["ats"], lambda a: a + x["diagonal"])))
        ).alias("places"),
    )
    shared = F.least(_covered(F.col("ats")), _covered(F.col("places")))
    measured = spans.select(
        "t1", "t2", "label", "template", "n_template", F.array_min("places").alias("first"),
        (F.array_max("places") + (K - 1)).alias("last"), shared.alias("shared"),
    ).withColumn("score", F.col("shared") / F.greatest("n_template", F.col("last") - F.col("first") + 1))
    good = measured.where(F.col("score") >= score)
    reach = int(longest / score) + 1
    beside = Window.partitionBy("t1", "t2").orderBy("first").rangeBetween(-reach, reach)
    rank = F.struct("score", "shared", (-F.col("template")).alias("earlier"), (-F.col("first")).alias("before"))
    ranked = good.withColumn("rank", rank).withColumn(
        "others", F.collect_list(F.struct("first", "last", "rank")).over(beside)
    )
    beaten = F.exists(
        "others",
        lambda x: (x["first"] <= F.col("last")) & (x["last"] >= F.col("first")) & (x["rank"] > F.col("rank")),
    )
    return ranked.where(~beaten).select("t1", "t2", "label", "template", "first", "last", "score")


def scan(
    docs: DataFrame,
    phrases: Sequence[Template],
    notices: Sequence[Template] = NOTICES,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: what its text states, by phrases and by notices.

    (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score):
    ``n_base`` counts all places of all phrases, first and last are their least
    and greatest start (words from 0, null without any); ``labels`` has the
    phrases' and the notices' labels; ``score`` is the best of the text, 1 for a
    phrase, 0 for nothing.  Labels are distinct, in order, joined by commas.

    A null text is empty: no words and empty labels.  Repeated rows and null ids
    each keep their row; other columns are ignored.  No list of templates finds nothing.
    """
    scratch = Scratch(docs.sparkSession, "licences")
    templates = template_table(docs.sparkSession, phrases, notices)
    longest = templates.where("not phrase").agg(F.max("n_template")).first()[0] or K
    found = scratch.keep(hits(docs, templates, doc_id, text), "hits")
    votes = diagonals(found)
    stated = phrase_places(votes, templates).select("t1", "t2", "label", "place", F.lit(1.0).alias("score"))
    alike = notice_spans(votes, templates, longest).select(
        "t1", "t2", "label", F.lit(None).cast("int").alias("place"), "score"
    )
    judged = stated.unionByName(alike).groupBy("t1", "t2").agg(
        F.count("place").alias("n_base"), F.min("place").cast("long").alias("first_word"),
        F.max("place").cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("place").isNotNull(), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"), F.max("score").alias("score"),
    )
    rows = found.where("place = -1").select("doc_id", "n_words", "t1", "t2")
    return rows.join(judged, ["t1", "t2"], "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
