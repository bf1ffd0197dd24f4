"""License scans: a trained paragraph classifier with template confirmation.

Native: DataFrame expressions and the JVM's logistic regression only.
The words of a block (the lines between two blank ones) become hashed bigrams
and trigrams, each hashed once, with the lines of its first and last word.  A
paragraph is a line (the n-grams inside it) or, for notices that are wrapped, a
whole block of any length; its n-grams count once.  A block counts for a family
that none of its lines is confirmed for, in place of their unconfirmed findings.
A sparse
multinomial logistic regression over the n-grams of licence notices is trained
on whole and cut notices against an ``unknown`` class: paragraphs of a bounded
sample of the corpus and legal phrases that name no licence.  A temperature
and an acceptance bound are calibrated on rows held out of the fit.  To score
the corpus, the n-grams are joined with the table of the nonzero
weights (at most ``MAX_FEATURES`` rows, broadcast) and summed by paragraph; paragraphs that
hold none have the intercepts alone, which is the unknown class by
construction.  A paragraph may name several families: each is weighed against
the unknown class alone.  A family is confirmed when enough of the n-grams of
one of its notices occur in the paragraph, and no less than of any notice of
another family that could be taken for it (``rivals``: GPL and LGPL headers
differ in a word or two).  Of the families that are not confirmed only the likeliest is reported.

Cases: NULL and empty texts have no paragraphs and no licence; repeated rows
are judged each; NULL ids are kept; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import json
import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorspark.llm.common import hashed_sample, let

UNKNOWN = "unknown"
MAX_FEATURES = 20_000
#: Notices by licence family (fixed values, public texts).
NOTICES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT license.", "This project is licensed under the terms of the MIT license.", "The MIT License (MIT)",
            "MIT License Copyright (c)", "MIT licensed", "available under the MIT license",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"],
    "ISC": ["ISC License", "Released under the ISC License.", "Licensed under the ISC license.",
            "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Released under the Apache License 2.0.", "Apache License Version 2.0, January 2004",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "Released under the GPL v2.", "Licensed under the GNU GPLv2.",
                "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version",
                "under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Released under the GPL v3.", "Licensed under the GNU GPLv3.",
                "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version"],
    "LGPL-2.1": ["Licensed under the GNU Lesser General Public License, version 2.1.", "Released under the LGPL v2.1.", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
                 "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or any later version",
                 "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version",
                 "under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version"],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3.", "Released under the LGPL v3.",
                 "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version"],
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3.", "Released under the AGPL v3.",
                 "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version"],
    "BSD": ["Released under the BSD License.", "Licensed under the BSD 3-Clause License.", "Licensed under the BSD 2-Clause License.",
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0."],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "Licensed under the Eclipse Public License 2.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "Released under the Unlicense."],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0": ["Released into the public domain under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
}
#: Identifiers of the families in machine-readable tags (fixed values).
TAGS = {"MIT": ["MIT"], "ISC": ["ISC"], "Apache-2.0": ["Apache-2.0"], "GPL-2.0": ["GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later"], "GPL-3.0": ["GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"],
        "LGPL-2.1": ["LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later"], "LGPL-3.0": ["LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later"],
        "AGPL-3.0": ["AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"], "BSD": ["BSD-2-Clause", "BSD-3-Clause"], "MPL-2.0": ["MPL-2.0"], "EPL-2.0": ["EPL-2.0"],
        "Unlicense": ["Unlicense"], "CC-BY": ["CC-BY-4.0"], "CC-BY-SA": ["CC-BY-SA-4.0"], "CC-BY-NC": ["CC-BY-NC-4.0"], "CC0": ["CC0-1.0"]}
#: Choices between two families that are commonly offered (fixed values).
CHOICES = [("MIT", "Apache-2.0"), ("Apache-2.0", "MIT")]
for _family, _tags in TAGS.items():
    NOTICES[_family] += [f"SPDX-License-Identifier: {t}" for t in _tags]
for _one, _other in CHOICES:
    for _family in (_one, _other):
        NOTICES[_family] += [f"Licensed under {_one} or {_other}", f"SPDX-License-Identifier: {_one} OR {_other}"]
#: Legal phrases that name no licence (fixed values), for the unknown class.
PHRASES = ["All rights reserved.", "Copyright by the author.", "Terms and conditions apply.", "See the licence agreement for details.",
           "Licensed under the terms agreed with the customer.", "This work is licensed to the publisher.", "Released under embargo.",
           "Your driving license, version and number.", "The license was released under pressure.", "Subject to the terms of the contract.",
           "under the terms of the agreement", "This project is a work in progress.", "Licensed premises under the management of the public house.",
           "to any person", "free of charge", "the following conditions are met", "in compliance with the law", "of this work", "to the extent possible"]


def words(paragraph: Column) -> Column:
    """Lower-cased runs of ASCII letters, digits and hyphens."""
    return F.filter(F.split(F.lower(paragraph), "[^a-z0-9-]+"), lambda w: (w != "") & (w != "-"))


def ngrams(w: Column) -> Column:
    """The distinct hashed bigrams and trigrams of a word array."""
    pairs = F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1)))
    triples = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    none = F.array().cast("array<bigint>")
    return F.array_distinct(F.concat(F.when(F.size(w) >= 2, pairs).otherwise(none), F.when(F.size(w) >= 3, triples).otherwise(none)))


def paragraph_grams(paragraph: Column) -> Column:
    return let(words(paragraph), ngrams)


def text_grams(text: Column) -> Column:
    """array<struct<block, first, last, g>>: the hashed bigrams and trigrams of a
    text, each with its block's first line and the lines of its first and last
    word.  A block ends at a line without a visible character; the ends of
    the text count as blank lines."""
    def gram(b, *at):
        return F.struct(b["at"].alias("block"), at[0]["line"].alias("first"), at[-1]["line"].alias("last"), F.xxhash64(*[t["w"] for t in at]).alias("g"))

    def of_words(b, w):
        pairs = F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: gram(b, F.get(w, i), F.get(w, i + 1)))
        triples = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: gram(b, F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        none = F.array().cast("array<struct<block:int,first:int,last:int,g:bigint>>")
        return F.concat(F.when(F.size(w) >= 2, pairs).otherwise(none), F.when(F.size(w) >= 3, triples).otherwise(none))

    def of_block(b):
        tokens = F.flatten(F.transform(b["lines"], lambda t, j: F.transform(words(t), lambda w: F.struct(w.alias("w"), (b["at"] + j).alias("line")))))
        return let(tokens, lambda w: of_words(b, w))

    def of_lines(p):
        blank = F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda i: ~F.get(p, i).rlike("\\S"))
        blocks = let(F.concat(F.array(F.lit(-1)), blank, F.array(F.size(p))), lambda e: F.filter(
            F.transform(F.sequence(F.lit(1), F.size(e) - 1), lambda k: F.struct(
                (F.get(e, k - 1) + 1).alias("at"), F.slice(p, F.get(e, k - 1) + 2, F.get(e, k) - F.get(e, k - 1) - 1).alias("lines"))),
            lambda b: F.size(b["lines"]) > 0))
        return F.flatten(F.transform(blocks, of_block))

    return let(F.split(text, "\n"), of_lines)


def _frame(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table from a JSON literal (stays in the JVM)."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("r")).select("r.*")


def _cuts(text: str) -> list[str]:
    """A notice whole, in other words' company, and cut."""
    w = text.split()
    out = [text, text.upper(), f"{text} {w[0]}", f"x {text}"]
    for n in (8, 12, 16, 24):
        out += [" ".join(w[i:i + n]) for i in range(0, len(w) - n + 1, 4)]
    return out


class Model:
    """Weights by n-gram, intercepts, calibrated temperature and bound."""

    def __init__(self, classes, weights, intercepts, temperature, bound):
        self.classes, self.weights, self.intercepts = classes, weights, intercepts
        self.temperature, self.bound = temperature, bound


def train(docs: DataFrame, sample_docs: int = 500, sample_paragraphs: int = 4000, l1: float = 2e-4, max_false: float = 0.001) -> Model:
    """Fit and calibrate the classifier.  The unknown class learns from at most
    ``sample_paragraphs`` paragraphs of ``sample_docs`` documents (the first by
    a hash of the text) that share few n-grams with any notice."""
    spark = docs.sparkSession
    known = [{"label": k, "text": c} for k, ns in NOTICES.items() for n in ns for c in _cuts(n)]
    known += [{"label": UNKNOWN, "text": c} for p in PHRASES for c in (p, p.upper(), f"the {p}", f"{p} of")]
    notices = _frame(spark, [{"text": n} for ns in NOTICES.values() for n in ns], "text string")
    grams = notices.select(F.explode(paragraph_grams(F.col("text"))).alias("g")).distinct()
    marks = [r.g for r in grams.collect()]
    picked = hashed_sample(docs.select(F.col("text").cast("string").alias("text")).filter("text IS NOT NULL"), ["text"], sample_docs)
    paras = (picked.select(F.explode(F.split("text", "\n")).alias("text")).distinct().withColumn("g", paragraph_grams(F.col("text")))
             .filter((F.size("g") > 0) & (F.size(F.array_intersect("g", F.array(*[F.lit(m) for m in marks]))) * 3 <= F.size("g")))
             .orderBy(F.xxhash64("text"), "text").limit(sample_paragraphs))
    rows = _frame(spark, known, "label string, text string").select("label", "text", paragraph_grams(F.col("text")).alias("g"))
    rows = rows.unionByName(paras.select(F.lit(UNKNOWN).alias("label"), "text", "g"))
    classes = [UNKNOWN, *sorted(NOTICES)]
    rows = rows.select(F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("label")).cast("double").alias("y"),
                       F.transform("g", lambda x: x.cast("string")).alias("g"),
                       (F.pmod(F.xxhash64("text"), F.lit(4)) == 0).alias("held")).withColumn("label", F.col("y") - 1)
    # only n-grams of the notices and phrases are features: others have no say and no weight
    vocabulary = [str(r.g) for r in _frame(spark, known, "label string, text string").select(
        F.explode(paragraph_grams(F.col("text"))).alias("g")).groupBy("g").count().orderBy(F.desc("count"), "g").limit(MAX_FEATURES).collect()]
    cv = CountVectorizer(inputCol="g", outputCol="features", binary=True)
    vec = cv.from_vocabulary(vocabulary) if hasattr(cv, "from_vocabulary") else None
    if vec is None:
        from pyspark.ml.feature import CountVectorizerModel
        vec = CountVectorizerModel.from_vocabulary(vocabulary, "g", "features").setBinary(True)
    data = vec.transform(rows).select("label", "features", "held")
    lr = LogisticRegression(family="multinomial", regParam=l1, elasticNetParam=1.0, maxIter=100, tol=1e-7).fit(data.filter("NOT held"))
    coef, bias = lr.coefficientMatrix.toArray(), lr.interceptVector.toArray()
    weights = {int(g): coef[:, i].tolist() for i, g in enumerate(vocabulary) if abs(coef[:, i]).max() > 1e-9}
    held = [(int(r.label), [float(x) for x in r.rawPrediction]) for r in lr.transform(data.filter("held")).select("label", "rawPrediction").collect()]

    def probabilities(z, t):
        top = max(z)
        e = [math.exp((x - top) / t) for x in z]
        return [x / sum(e) for x in e]

    temperature = min((0.25 * i for i in range(1, 17)),
                      key=lambda t: (sum(-math.log(max(probabilities(z, t)[y], 1e-12)) for y, z in held), t))
    false = sorted(1 - probabilities(z, temperature)[0] for y, z in held if y == 0)
    bound = max(0.5, false[max(0, math.ceil(len(false) * (1 - max_false)) - 1)]) if false else 0.5
    return Model(classes, weights, bias.tolist(), temperature, min(bound, 0.95))


def rivals(grams: dict[int, set], families: list[str], confirm: float) -> dict[int, list[int]]:
    """For each notice the notices of other families that hold so many of its
    n-grams that they could confirm it."""
    return {i: [j for j in grams if families[j] != families[i] and len(grams[i] & grams[j]) >= 0.8 * confirm * len(grams[i]) and grams[i] != grams[j]]
            for i in grams}


def _judge(docs: DataFrame, model: Model, confirm: float) -> DataFrame:
    """(row, doc_id, block, family, found) of every block and family of its
    licence paragraphs, found their array<struct<paragraph, probability, cover,
    confirmed>>.  Paragraphs of no family and a marker for every document, so
    that none is lost, have family NULL and nothing found."""
    spark = docs.sparkSession
    templates = [(k, n) for k, ns in sorted(NOTICES.items()) for n in ns]
    frame = _frame(spark, [{"i": i, "text": n} for i, (_, n) in enumerate(templates)], "i int, text string")
    own = {r.i: set(r.g) for r in frame.select("i", paragraph_grams(F.col("text")).alias("g")).collect()}
    against = rivals(own, [f for f, _ in templates], confirm)
    zero = [0.0] * len(model.classes)
    known = sorted(set(model.weights).union(*own.values()))
    marker = next(i for i in range(len(known) + 1) if i not in set(known))
    table = [{"g": g, "w": model.weights.get(g, zero), "t": [i for i in own if g in own[i]]} for g in [*known, marker]]
    weights = _frame(spark, table, "g long, w array<double>, t array<int>")

    grams = text_grams(F.coalesce(F.col("text").cast("string"), F.lit("")))
    mark = F.struct(F.lit(-1).alias("block"), F.lit(-1).alias("first"), F.lit(-1).alias("last"), F.lit(marker).cast("long").alias("g"))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.array_append(grams, mark).alias("u"))
    # outer: for the plain form the optimiser adds a filter that computes the arrays once more
    p = rows.select("row", "doc_id", F.explode_outer("u").alias("u")).select("row", "doc_id", "u.block", "u.first", "u.last", "u.g")
    hit = p.join(F.broadcast(weights), "g")          # at most MAX_FEATURES rows and those of the notices
    block = F.struct(F.lit(True).alias("joined"), F.col("block").alias("paragraph"))
    line = F.struct(F.lit(False).alias("joined"), F.col("first").alias("paragraph"))
    units = hit.withColumn("u", F.explode(F.when(F.col("first") == F.col("last"), F.array(line, block)).otherwise(F.array(block))))
    units = units.select("row", "doc_id", "block", "u.joined", "u.paragraph", "g", "w", "t").dropDuplicates(["row", "joined", "paragraph", "g"])
    sums = units.groupBy("row", "doc_id", "block", "joined", "paragraph").agg(
        *[F.sum(F.get("w", F.lit(i))).alias(f"w{i}") for i in range(len(model.classes))],
        *[F.count(F.when(F.array_contains("t", i), 1)).alias(f"t{i}") for i in range(len(templates))])
    z = F.array(*[(F.col(f"w{i}") + F.lit(float(b))) / F.lit(float(model.temperature)) for i, b in enumerate(model.intercepts)])
    cover = F.array(*[F.col(f"t{i}") / F.lit(float(max(1, len(own[i])))) for i in range(len(templates))])
    top = sums.withColumn("z", z).withColumn("cover", cover)
    c = lambda i: F.get("cover", F.lit(i))
    found = []
    for at, family in enumerate(model.classes[1:], 1):
        mine = [i for i, (f, _) in enumerate(templates) if f == family]
        sure = F.lit(False)
        for i in mine:
            here = c(i) >= F.lit(float(confirm))
            for j in against[i]:
                here = here & (c(i) >= c(j))
            sure = sure | here
        # against the unknown class alone
        odds = F.get("z", F.lit(at)) - F.get("z", F.lit(0))
        found.append(F.struct(F.lit(family).alias("family"), (1 / (1 + F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), -odds))))).alias("probability"),
                              F.greatest(F.lit(0.0), *[c(i) for i in mine]).alias("cover"), sure.alias("confirmed")))
    accepted = F.filter(F.array(*found), lambda f: f["probability"] >= F.lit(float(model.bound)))
    kept = let(accepted, lambda a: F.filter(a, lambda f: f["confirmed"] | (f["probability"] == F.array_max(F.transform(a, lambda g: g["probability"])))))
    judged = top.select("row", "doc_id", "block", "joined", "paragraph", F.explode_outer(F.when(F.col("paragraph") >= 0, kept)).alias("f")).select(
        "row", "doc_id", "block", "f.family", F.struct("joined", "paragraph", "f.probability", "f.cover", "f.confirmed").alias("u"))
    blocks = judged.groupBy("row", "doc_id", "block", "family").agg(F.array_sort(F.collect_list(F.when(F.col("family").isNotNull(), F.col("u")))).alias("u"))
    lines = F.filter("u", lambda x: ~x["joined"])
    whole = F.filter("u", lambda x: x["joined"] & x["confirmed"])
    wrapped = (F.size(whole) > 0) & ~F.exists(lines, lambda x: x["confirmed"])
    return blocks.select("row", "doc_id", "block", "family", F.transform(F.when(wrapped, whole).otherwise(lines), lambda x: F.struct(
        *[x[c].alias(c) for c in ("paragraph", "probability", "cover", "confirmed")])).alias("found"))


def scan_paragraphs(docs: DataFrame, model: Model, confirm: float = 0.6) -> DataFrame:
    """doc_id, paragraph (its first line, from 0), family, probability (against
    the unknown class), cover, confirmed of every paragraph that the classifier
    assigns to a licence family."""
    p = _judge(docs, model, confirm).filter("family IS NOT NULL")
    return p.select("doc_id", "family", F.explode("found").alias("f")).select("doc_id", "f.paragraph", "family", "f.probability", "f.cover", "f.confirmed")


def scan(docs: DataFrame, model: Model | None = None, confirm: float = 0.6, **how) -> DataFrame:
    """One row a document: its confirmed licence families, the number of
    confirmed and of unconfirmed licence paragraphs and the best probability."""
    p = _judge(docs, model or train(docs, **how), confirm).withColumn("sure", F.size(F.filter("found", lambda x: x["confirmed"])))
    return p.groupBy("row", "doc_id").agg(
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("sure") > 0, F.col("family")))), ",").alias("families"),
        F.sum("sure").alias("n_confirmed"), F.sum(F.size("found") - F.col("sure")).alias("n_unconfirmed"),
        F.coalesce(F.max(F.array_max(F.transform("found", lambda x: x["probability"]))), F.lit(0.0)).alias("probability")).drop("row")
