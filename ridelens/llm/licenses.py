"""Licences of files by TF-IDF cosine to templates, and from the nearest directory above."""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridelens.llm.shared import stored

THRESHOLD = 0.75

# Sentences by which well-known licences are named or begin.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "You may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights (CC0 1.0)."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

SENTENCE = r"\n|(?<=[.!?])\s+"
NO_TERM = "[^a-z0-9]+"


def template_terms(text: str) -> list[str]:
    return [t for t in re.split(NO_TERM, text.lower()) if t]


def template_weights(templates=TEMPLATES) -> tuple[list[tuple[int, str, str, float]], dict[str, float], float]:
    """(number, licence, term, weight) of unit vectors; idf by term; idf of terms of no template."""
    counted = [(name, Counter(template_terms(text))) for name, text in templates]
    df = Counter(term for _, terms in counted for term in terms)
    idf = {t: math.log((1 + len(templates)) / (1 + n)) + 1 for t, n in df.items()}
    rows = []
    for i, (name, terms) in enumerate(counted):
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in terms.items()))
        rows += [(i, name, t, n * idf[t] / norm) for t, n in sorted(terms.items())]
    return rows, idf, math.log(1 + len(templates)) + 1


def fewest_terms(rows: list[tuple[int, str, str, float]], threshold: float) -> list[tuple[list[str], int]]:
    """Terms of each template, and how many of them a sentence needs to reach the threshold.

    The cosine is at most the length of the part of the template's unit vector that the
    sentence shares, so fewer terms than make up that length, heaviest first, never do.
    """
    needs = []
    for i in sorted({r[0] for r in rows}):
        left, own = (threshold - 1e-6) ** 2, sorted((r for r in rows if r[0] == i), key=lambda r: (-r[3], r[2]))
        n = 0
        while left > 1e-12 and n < len(own):
            left -= own[n][3] ** 2
            n += 1
        needs.append(([term for *_, term, _ in own], n))
    return needs


def _may_reach(sentence: Column, needs: list[tuple[list[str], int]]) -> Column:
    """Whether a sentence has enough terms of some template; the terms it has are found once."""

    def enough(found: Column) -> Column:
        some = F.lit(False)
        for terms, n in needs:
            some = some | (F.size(F.array_intersect(found, F.lit(terms))) >= n)
        return (F.size(found) >= min(n for _, n in needs)) & some

    all_terms = sorted({term for terms, _ in needs for term in terms})
    return F.exists(F.array(F.array_intersect(F.split(sentence, NO_TERM), F.lit(all_terms))), enough)


def own_licences(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """path, licence and score: each file's sentence closest to a template, where it reaches the threshold.

    Of equal scores the first licence by name counts.
    """
    rows, idf, rare = template_weights()
    spark = files.sparkSession
    weights = spark.createDataFrame(rows, "template int, licence string, term string, weight double")
    idfs = spark.createDataFrame(sorted(idf.items()), "term string, idf double")
    sentences = files.where("text is not null").select("path", F.explode(F.split("text", SENTENCE)).alias("sentence"))
    sentences = sentences.select("path", F.lower("sentence").alias("sentence"))
    sentences = stored(sentences.where(_may_reach(F.col("sentence"), fewest_terms(rows, threshold))), "licence-sentences").distinct()
    terms = sentences.select("path", "sentence", F.explode(F.split("sentence", NO_TERM)).alias("term")).where("term != ''")
    terms = terms.groupBy("path", "sentence", "term").agg(F.count(F.lit(1)).alias("n"))
    terms = terms.join(F.broadcast(idfs), "term", "left").withColumn("w", F.col("n") * F.coalesce("idf", F.lit(rare)))
    norms = terms.groupBy("path", "sentence").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = terms.join(F.broadcast(weights), "term").groupBy("path", "sentence", "template", "licence").agg(
        F.sum(F.col("w") * F.col("weight")).alias("dot")
    )
    scored = dots.join(norms, ["path", "sentence"]).select("path", "licence", F.round(F.col("dot") / F.col("norm"), 6).alias("score"))
    best = scored.where(F.col("score") >= threshold).groupBy("path").agg(
        F.min_by("licence", F.struct(-F.col("score"), F.col("licence"))).alias("licence"), F.max("score").alias("score")
    )
    return best


def licences(files: DataFrame, threshold: float = THRESHOLD, licence_file: str = r"(?i)^(licen[cs]e|copying)(\..*)?$", keep: tuple[str, ...] = ()) -> DataFrame:
    """The `keep` columns, path, licence, score, how and licence_dir of every file (path, text).

    A file's own licence counts first (`own`), then that of the nearest directory above
    with a licence file that has one (`inherited`, with the directory), else `none`. Of
    several licence files of a directory the highest score counts, then the first name.
    Null and empty texts have no licence of their own. Repeated paths are one file: its
    closest sentence counts for all its rows. A null path has no directory and no licence.
    Directories are looked up once each and not for every file in them.
    """
    own = own_licences(files, threshold)
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    placed = files.select(*keep, "path", folder.alias("dir"))
    named = own.where(F.regexp_extract("path", "([^/]*)$", 1).rlike(licence_file)).select(folder.alias("above"), "licence", "score")
    given = named.groupBy("above").agg(F.min_by("licence", F.struct(-F.col("score"), F.col("licence"))).alias("given"))
    dirs = placed.where("dir is not null").select("dir").distinct()
    parts = F.split("dir", "/")
    steps = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("above")))
    above = dirs.select("dir", F.inline(steps)).join(given, "above")
    nearest = above.groupBy("dir").agg(F.max_by("given", "depth").alias("given"), F.max_by("above", "depth").alias("licence_dir"))
    all_files = placed.join(own, "path", "left").join(nearest, "dir", "left")
    mine = F.col("licence").isNotNull()
    return all_files.select(
        *keep,
        "path",
        F.coalesce("licence", "given").alias("licence"),
        "score",
        F.when(mine, "own").when(F.col("given").isNotNull(), "inherited").otherwise("none").alias("how"),
        F.when(~mine, F.col("licence_dir")).alias("licence_dir"),
    )


def standin_path(doc_id: str = "doc_id", source: str = "source", lang: str = "lang") -> Column:
    """A path for a document, as documents have none: source, language and one of seven folders by id.

    Every twentieth is a licence file, in one of these three directories by turns.
    """
    c = F.col(doc_id)
    turn = F.floor(c / 20) % 3
    dirs = F.concat_ws(
        "/",
        F.coalesce(F.col(source), F.lit("none")),
        F.when((c % 20 != 0) | (turn > 0), F.coalesce(F.col(lang), F.lit("none"))),
        F.when((c % 20 != 0) | (turn > 1), F.concat(F.lit("d"), c % 7)),
    )
    name = F.when(c % 20 == 0, F.concat(F.lit("LICENSE."), c)).otherwise(F.concat(c, F.lit(".txt")))
    return F.concat(dirs, F.lit("/"), name)
