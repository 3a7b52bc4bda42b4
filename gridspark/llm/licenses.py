"""Licence notices in documents: a trained paragraph classifier, a calibrated unknown class and a comparison with templates.

All of it runs on DataFrames and MLlib. A paragraph is a line. Its features are runs of one to three words that hold an anchor
word and occur in a template or a counter-example; a paragraph without an anchor has no feature and is no notice. The
classifier is a multinomial logistic regression over licence families and ``none``. The probability from which a family is
believed is calibrated on paragraphs that were kept from the fit. A believed family is confirmed where enough of one of its
templates' word pairs is in the paragraph; else the notice is ``unknown``."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.operators.scan import exact_quantiles
from gridspark.session import cut_lineage

NONE, UNKNOWN = "none", "unknown"

#: Usual notices of each family: fixed values.
TEMPLATES = {
    "AGPL": (
        "This program is licensed under the GNU Affero General Public License, version 3",
        "Licensed under the GNU Affero General Public License v3.0 or later",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License",
        "Released under the Apache License 2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "BSD": (
        "Licensed under the BSD 3-Clause License",
        "Released under the BSD License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ),
    "CC0": (
        "To the extent possible under law the author has waived all copyright, CC0 1.0 Universal public domain dedication",
        "Released into the public domain under CC0",
        "This is free and unencumbered software released into the public domain under the Unlicense",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "Licensed under the GNU General Public License v2.0",
        "Released under the GPL version 3 license",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "LGPL": (
        "Licensed under the GNU Lesser General Public License, version 2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "MIT": (
        "Released under the MIT License",
        "Licensed under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
        "SPDX-License-Identifier: MIT",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "Licensed under the Mozilla Public License 2.0",
        "SPDX-License-Identifier: MPL-2.0",
    ),
}

#: Paragraphs that speak of licences without giving one: fixed values.
COUNTER_EXAMPLES = (
    "The driver showed a license to the officer at the road",
    "A fishing license costs more this year",
    "Copyright law protects the work of an author",
    "All rights reserved, no copyright infringement intended",
    "You need the permission of your parents",
    "The public library opens at ten",
    "The software version 2 was released in spring",
    "The general public may enter free of charge",
    "MIT is a university in Massachusetts",
    "The apache helicopter landed",
    "Licensed premises, license number on request",
    "The terms of the license are set out elsewhere",
    "Licensed under a private agreement between the parties",
    "Redistribution of wealth is a political question",
    "The creative director left the commons",
    "A gnu is a large antelope",
)

#: Words one of which is in every template: fixed values. A paragraph without one is no notice.
ANCHORS = (
    "license", "licensed", "licenses", "licence", "licenced", "unlicense", "copyright", "permission", "redistribution", "redistribute", "spdx",
    "gnu", "gpl", "lgpl", "agpl", "affero", "apache", "bsd", "mozilla", "mpl", "creative", "commons", "cc0", "domain",
)
#: Words that count in features beside the anchors but are too common elsewhere to select a paragraph: fixed values.
NAMES = ("mit", "cc")
#: Parts of words one of which is in every anchor: fixed values. A text without one is not cut into paragraphs.
STEMS = ("licen", "copyright", "permission", "redistribut", "spdx", "gnu", "gpl", "affero", "apache", "bsd", "mozilla", "mpl", "creative", "commons", "cc0", "domain")
# Sets of features in one part.
PART_SETS = 20_000
WORD_SQL = r"[\p{L}\p{N}]+"
ANCHOR_SQL = r"(?<![\p{L}\p{N}])(?:" + "|".join(ANCHORS) + r")(?![\p{L}\p{N}])"


def split_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_SQL), F.lit(0))


def features(tokens: Column) -> Column:
    """Runs of one to three words that hold an anchor or a name: the six around each of them that fit the paragraph."""
    size = F.size(tokens)
    places = F.filter(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: F.try_element_at(tokens, i).isin(*ANCHORS, *NAMES))
    spans = [(0, 1), (0, 2), (-1, 2), (0, 3), (-1, 3), (-2, 3)]

    def around(i: Column) -> Column:
        fit = [F.when((i + start >= 1) & (i + start + n - 1 <= size), F.array_join(F.slice(tokens, F.greatest(i + start, F.lit(1)), n), " ")) for start, n in spans]
        return F.array_compact(F.array(*fit))

    return F.array_distinct(F.flatten(F.transform(places, around)))


class LicenseModel:
    """What a fit leaves: the vocabulary, the regression, the families and the believed probability."""

    def __init__(self, vocabulary: list[str], regression: LogisticRegressionModel, families: list[str], believed: float):
        self.counter = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="_grams", outputCol="_features")
        self.counter.setBinary(True)
        self.regression, self.families, self.believed = regression, families, believed

    def score(self, paragraphs: DataFrame) -> DataFrame:
        """Adds ``family`` and ``probability`` to paragraphs with ``_tokens``; ``none`` where no feature is known."""
        return self.judge(self.counter.transform(paragraphs.withColumn("_grams", features(F.col("_tokens")))), paragraphs.columns)

    def judge(self, counted: DataFrame, keep: list[str]) -> DataFrame:
        """The same for rows whose ``_features`` are known."""
        scored = self.regression.setFeaturesCol("_features").setProbabilityCol("_p").setPredictionCol("_best").setRawPredictionCol("_raw").transform(counted)
        probability = vector_to_array("_p")
        names = F.array(*map(F.lit, self.families))
        known = F.exists(vector_to_array("_features"), lambda x: x > 0)
        return scored.select(
            *keep, F.when(known, F.element_at(names, F.col("_best").cast("int") + 1)).otherwise(NONE).alias("family"),
            F.when(known, F.array_max(probability)).otherwise(1.0).alias("probability"),
        )


def fit(spark: SparkSession, background: DataFrame | None = None, weight: float = 2000.0, false_rate: float = 0.01, least: float = 0.5) -> LicenseModel:
    """Fit on the templates, the counter-examples and all paragraphs of ``background`` (text) that hold an anchor, without those
    that resemble a template.

    Paragraphs are counted by their known features in the tasks that read them, so the fit meets each set of features once.
    The templates are few: where ``background`` has more than ``weight`` paragraphs with an anchor, their numbers are scaled to
    that sum, so that a larger corpus doesn't outweigh the templates. Each template also appears with words before and after it, so the
    position of a notice does not matter. The believed probability is the least, from ``least`` on, that at most ``false_rate``
    of all held-out paragraphs that are no notice exceed with a family; every other counter-example and background paragraph is
    held out."""
    notices = [(f, t, False) for f, ts in TEMPLATES.items() for t in ts]
    notices += [(f, f"{before} {t} {after}", False) for f, ts in TEMPLATES.items() for t in ts for before, after in (("copyright 2024 the authors", "see the file for details"), ("all code here is", "with no warranty"))]
    others = [(NONE, t, i % 2 == 1) for i, t in enumerate(COUNTER_EXAMPLES)]
    rows = spark.createDataFrame(notices + others, "family string, text string, held boolean").withColumn("_grams", features(split_words(F.col("text"))))
    vocabulary = [r[0] for r in rows.select(F.explode("_grams").alias("g")).distinct().orderBy("g").collect()]
    counter = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="_grams", outputCol="_features").setBinary(True)
    data = counter.transform(rows).select("family", "held", "_features", F.lit(1).cast("long").alias("_n"), F.lit(1.0).alias("_weight"))
    sets = 0
    if background is not None:
        seen = cut_lineage(background_features(background, counter))
        sets, total = seen.agg(F.count(F.lit(1)), F.sum("_n")).first()
        scaled = F.col("_n") * F.lit(min(1.0, weight / max(total or 0, 1)))
        data = data.unionByName(seen.where("strange").select(F.lit(NONE).alias("family"), "held", "_features", "_n", scaled.alias("_weight")))
    families = [*sorted(TEMPLATES), NONE]
    label = F.array_position(F.array(*map(F.lit, families)), F.col("family")) - 1
    # A fit is a chain of jobs, each over all parts.
    data = data.withColumn("label", label.cast("double")).coalesce(1 + sets // PART_SETS)
    regression = LogisticRegression(family="multinomial", featuresCol="_features", weightCol="_weight", regParam=0.002, maxIter=100, tol=1e-6).fit(data.filter("not held"))
    model = LicenseModel(vocabulary, regression, families, least)
    false = model.judge(data.filter("held").select("_features", "_n"), ["_n"]).select(F.when(F.col("family") == NONE, 0.0).otherwise(F.col("probability")).alias("p"), "_n")
    bound = exact_quantiles(false, "p", {"p": 1 - false_rate}, count="_n").first()["p"]
    model.believed = max(least, bound or 0.0)
    return model


def background_features(background: DataFrame, counter: CountVectorizerModel) -> DataFrame:
    """held, strange, _features and the number ``_n`` of the paragraphs with an anchor that share them; those that resemble a template aren't strange."""
    lines = background.select(F.explode(anchored(F.col("text"))).alias("text")).select("text", split_words(F.col("text")).alias("_tokens"))
    strange = F.greatest(*[_similarity(F.col("_words"), f) for f in TEMPLATES]) < 0.3
    held = F.pmod(F.xxhash64("text"), F.lit(2)) == 1
    marked = lines.withColumn("_words", spaced(F.col("_tokens"))).select(held.alias("held"), strange.alias("strange"), features(F.col("_tokens")).alias("_grams"))
    return counter.transform(marked).groupBy("held", "strange", "_features").agg(F.count(F.lit(1)).alias("_n"))


def anchored(text: Column) -> Column:
    """The paragraphs of a text, in lower case, that hold an anchor word."""
    def of(low: Column) -> Column:
        maybe = reduce(lambda a, b: a | b, [low.contains(x) for x in STEMS])
        return F.when(maybe, F.filter(F.split(low, r"[\r\n]+"), lambda p: p.rlike(ANCHOR_SQL))).otherwise(F.array().cast("array<string>"))

    # the lower-cased text is bound once, as the only element of an array
    return F.element_at(F.transform(F.array(F.lower(F.coalesce(text, F.lit("")))), of), 1)


def _pairs(text: str) -> list[str]:
    own = re.findall(r"[^\W_]+", text.lower())
    return sorted({f" {a} {b} " for a, b in zip(own, own[1:], strict=False)})


def _similarity(words: Column, family: str) -> Column:
    """The largest share of a template's word pairs in a paragraph; ``words`` are its words between single spaces."""
    shares = []
    for template in TEMPLATES[family]:
        pairs = _pairs(template)
        shares.append(reduce(lambda a, b: a + b, [words.contains(p).cast("int") for p in pairs]) / F.lit(float(len(pairs))))
    return F.greatest(*shares)


def spaced(tokens: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))


def scan(docs: DataFrame, model: LicenseModel, confirm: float = 0.6) -> DataFrame:
    """doc_id, license, probability, similarity, n_notices, n_paragraphs for every row of ``docs`` (doc_id, text).

    ``license`` is the family of the document's best notice: confirmed by a template first, then by probability, then the
    first name; ``unknown`` where some paragraph is believed to be a notice but no template confirms it, ``none`` where no
    paragraph is. ``n_notices`` counts confirmed paragraphs, ``n_paragraphs`` those with an anchor word. Null and empty
    texts give ``none``; repeated rows keep a row each; an empty table gives none; other columns are ignored."""
    lines = docs.select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), anchored(F.col("text")).alias("_lines"))
    lines = lines.select("_row", "doc_id", F.explode_outer("_lines").alias("_line")).select("_row", "doc_id", F.col("_line").isNotNull().alias("_is"), split_words(F.coalesce("_line", F.lit(""))).alias("_tokens"))
    scored = model.score(lines.withColumn("_words", spaced(F.col("_tokens"))))
    similar = F.lit(0.0)
    for family in TEMPLATES:
        similar = F.when(F.col("family") == family, _similarity(F.col("_words"), family)).otherwise(similar)
    marked = scored.withColumn("_similar", similar)
    believed = (F.col("family") != NONE) & (F.col("probability") >= model.believed)
    confirmed = believed & (F.col("_similar") >= confirm)
    kind = F.when(confirmed, F.col("family")).when(believed, F.lit(UNKNOWN)).otherwise(NONE)
    place = F.when(confirmed, 0).when(believed, 1).otherwise(2)
    best = F.min(F.struct(place.alias("place"), (-F.col("probability")).alias("less"), kind.alias("kind"), F.col("_similar").alias("similar")))
    out = marked.groupBy("_row", "doc_id").agg(best.alias("b"), F.sum(confirmed.cast("long")).alias("n_notices"), F.sum(F.col("_is").cast("long")).alias("n_paragraphs"))
    return out.select(
        "doc_id", F.col("b.kind").alias("license"), F.when(F.col("b.kind") == NONE, 0.0).otherwise(-F.col("b.less")).alias("probability"),
        F.when(F.col("b.kind") == NONE, 0.0).otherwise(F.col("b.similar")).alias("similarity"), "n_notices", "n_paragraphs",
    )
