"""Licence scan: a trained paragraph classifier, in DataFrame and ML pipeline functions only.

Texts are cut into paragraphs (lines, and sentences within them). Every paragraph with a word
becomes sparse counts of hashed word uni- and bigrams for a multinomial logistic regression over
licence families and an unknown class; no paragraph is kept from it. Predictions below a
probability that is calibrated on the training phrases' held-out wordings count as unknown. A
prediction is confirmed by comparison with the family's template: most of the paragraph's word
pairs must occur there.

The training phrases are rules (sentence frames times names, and the frames' words alone, which
name no licence, so a bare "MIT" or "mit" is unknown) and a few well-known notice sentences, so
the training set is fixed and small.

Paragraphs are judged where their row was read and only one partial result a row is shuffled.

A null or empty text has no paragraphs and gets zero counts. Repeated rows are scanned
each on its own. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURES = 1 << 12
UNKNOWN = "unknown"
#: Share of a paragraph's word pairs that its family's template must hold.
CONFIRM = 0.6

#: Fixed names by family.
NAMES = {
    "agpl": ["GNU Affero General Public License", "AGPL-3.0", "GNU Affero General Public License, version 3", "AGPLv3"],
    "apache": ["Apache License", "Apache License, Version 2.0", "Apache-2.0", "Apache 2.0 license"],
    "bsd": ["BSD License", "BSD 3-Clause License", "BSD-2-Clause", "BSD-3-Clause", "Simplified BSD License"],
    "cc-by": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License", "CC-BY-4.0"],
    "cc-by-nc": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "CC-BY-NC-4.0", "CC BY-NC-SA 4.0"],
    "cc-by-sa": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-SA-4.0", "CC BY-SA 3.0"],
    "cc0": ["CC0 1.0 Universal", "CC0 1.0", "CC0-1.0", "Creative Commons Zero"],
    "gpl": ["GNU General Public License", "GNU General Public License, version 3", "GNU General Public License, version 2", "GPL-3.0", "GPLv3", "GPL-2.0", "GNU GPL"],
    "isc": ["ISC License", "ISC"],
    "lgpl": ["GNU Lesser General Public License", "LGPL-2.1", "LGPL-3.0", "GNU LGPL", "GNU Lesser General Public License, version 3"],
    "mit": ["MIT License", "MIT", "Expat License", "The MIT License"],
    "mpl": ["Mozilla Public License", "Mozilla Public License, version 2.0", "MPL-2.0", "Mozilla Public License Version 2.0"],
    "proprietary": ["proprietary license", "commercial license", "end user license agreement"],
    "unlicense": ["Unlicense", "The Unlicense"],
}
#: Sentence frames of notices.
FRAMES = ["Released under the {}.", "Licensed under the {}.", "Licensed under {}.", "This work is licensed under the {}.", "Distributed under the terms of the {}.", "This software is available under the {}.", "SPDX-License-Identifier: {}", "License: {}", "See the {} for details.", "{}"]
#: Well-known notice sentences.
NOTICES = {
    "apache": ["you may not use this file except in compliance with the License", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "mit": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "gpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "unlicense": ["This is free and unencumbered software released into the public domain"],
    "cc0": ["The person who associated a work with this deed has dedicated the work to the public domain"],
    "proprietary": ["All rights reserved. No part of this publication may be reproduced without permission", "Unauthorized copying of this file is strictly prohibited, proprietary and confidential"],
}
#: Sentences with cue words that name no licence.
OTHER = [
    "A valid driving license is required to rent a {}.",
    "The {} was granted permission to enter the building.",
    "Copyright law changed in the nineteenth century {}.",
    "The dealer offers a two year warranty on every {}.",
    "She studied the history of the commons and the {}.",
    "The apache helicopter landed near the {}.",
    "Researchers at MIT published a study of the {}.",
    "The general public may visit the {} on Sundays.",
    "He released the {} under great pressure.",
    "The version of the {} that was distributed to schools.",
    "Public access to the {} is free on the first day of the month.",
    "The fishing license for the {} expires in May.",
]
THINGS = ["car", "museum", "report", "lake", "committee", "school", "product", "engine", "garden"]

_models: dict[str, tuple[LogisticRegressionModel, float]] = {}


def grams_of(text: Column) -> Column:
    """Lower-case words and word pairs."""
    # a-z and 0-9 are letters and numbers as well; named first, they need no look at the tables of Unicode.
    words = F.array_remove(F.split(F.lower(text), r"[^a-z0-9\p{L}\p{N}]+"), "")
    return F.flatten(F.transform(F.array(words), lambda w: F.concat(w, F.transform(F.slice(w, 2, F.size(w)), lambda x, i: F.concat(F.get(w, i), F.lit(" "), x)))))


def training_phrases() -> list[tuple[str, str, int]]:
    """(family, text, fold) for all frames and names; fold 0 is held out for calibration."""
    rows = []
    for family, names in NAMES.items():
        rows += [(family, frame.format(name)) for name in names for frame in FRAMES]
        rows += [(family, text) for text in NOTICES.get(family, []) for _ in range(4)]
    rows += [(UNKNOWN, frame.format(thing)) for frame in OTHER for thing in THINGS]
    rows += [(UNKNOWN, word) for word in sorted({w for frame in [*FRAMES, *OTHER] for w in frame.replace("{}", "").split()})]
    return [(family, text, i % 7) for i, (family, text) in enumerate(rows)]


def labels() -> list[str]:
    return sorted([*NAMES, UNKNOWN])


def _hashed(rows: DataFrame) -> DataFrame:
    return HashingTF(numFeatures=FEATURES, inputCol="grams", outputCol="features", binary=True).transform(rows)


def train(spark: SparkSession) -> tuple[LogisticRegressionModel, float]:
    """The model, and the least probability of a family that is right on at least 99 percent of the held-out phrases."""
    key = spark.sparkContext.applicationId
    if key not in _models:
        place = {x: float(i) for i, x in enumerate(labels())}
        phrases = spark.createDataFrame([(place[f], t, k) for f, t, k in training_phrases()], "label double, text string, fold int").coalesce(1)
        rows = _hashed(phrases.withColumn("grams", grams_of(F.col("text"))))
        model = LogisticRegression(maxIter=40, regParam=0.002, family="multinomial").fit(rows.where("fold != 0"))
        scored = model.transform(rows.where("fold = 0")).select((F.col("prediction") == F.col("label")).alias("right"), F.array_max(vector_to_array("probability")).alias("p"), (F.col("label") != place[UNKNOWN]).alias("licence"))
        wrong = scored.where("not right").agg(F.max("p")).first()[0]  # one number
        low = scored.where("right and licence").agg(F.expr("percentile(p, 0.01)")).first()[0]  # one number
        # Only the probabilities are used; the other columns would be computed for every paragraph.
        model = model.setRawPredictionCol("").setPredictionCol("")
        _models.clear()
        _models[key] = (model, float(min(max(low or 0.0, min(wrong or 0.0, 0.5)), 0.6)))
    return _models[key]


def _templates(spark: SparkSession) -> Column:
    """Map from family to the word pairs and words of all its phrases, a constant of the plan."""
    phrases = spark.createDataFrame([(f, t) for f, t, _ in training_phrases() if f != UNKNOWN], "family string, text string")
    grams = phrases.select("family", F.explode(grams_of(F.col("text"))).alias("gram")).groupBy("family").agg(F.sort_array(F.collect_set("gram")).alias("grams"))
    return F.create_map(*[x for r in grams.collect() for x in (F.lit(r["family"]), F.lit(r["grams"]))])  # as many as the fixed phrases have


def paragraphs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row, doc_id, text: the paragraphs with a word; one row with a null text for a document without any."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    cut = F.filter(F.split("text", r"\n|(?=[ \t])(?<=[.;!?])[ \t]+"), lambda p: p.rlike(r"[a-z0-9\p{L}\p{N}]"))
    return rows.select("row", "doc_id", F.explode_outer(cut).alias("text"))


def classify(parts: DataFrame, spark: SparkSession) -> DataFrame:
    """parts with a column text, plus k (place of the family in labels()), family (or unknown), probability and confirmed."""
    model, least = train(spark)
    names = F.array(*[F.lit(x) for x in labels()])
    scored = _hashed(parts.withColumn("grams", F.coalesce(grams_of(F.col("text")), F.array().cast("array<string>"))))
    scored = model.transform(scored).withColumn("p", vector_to_array("probability")).withColumn("probability", F.array_max("p"))
    k = F.when(F.col("probability") >= least, (F.array_position("p", F.col("probability")) - 1).cast("int")).otherwise(F.lit(labels().index(UNKNOWN)))
    scored = scored.withColumn("k", k).withColumn("family", F.get(names, F.col("k")))
    mine = F.array_distinct("grams")
    known = F.size(F.array_intersect(mine, _templates(spark)[F.col("family")]))
    # A paragraph without words has no pair that a template could hold.
    sure = F.when((F.col("family") != UNKNOWN) & (F.size("grams") > 0), known >= F.size(mine) * CONFIRM).otherwise(F.lit(False))
    return scored.withColumn("confirmed", sure).drop("p", "features", "grams")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_candidates (paragraphs with a word), n_confirmed, n_unknown, families (sorted, comma-joined) and best_score for every row."""
    judged = classify(paragraphs(docs, id_col, text_col), docs.sparkSession)
    sure = F.col("confirmed")
    per_row = judged.groupBy("row", "doc_id").agg(
        F.count("text").alias("n"),
        F.count_if(sure).alias("c"),
        F.bit_or(F.when(sure, F.expr("shiftleft(1, k)")).otherwise(F.lit(0))).alias("bits"),
        F.max(F.when(sure, F.round("probability", 6))).alias("best_score"),
    )
    families = F.concat_ws(",", *[F.when(F.col("bits").bitwiseAND(1 << k) != 0, F.lit(x)) for k, x in enumerate(labels())])
    return per_row.select("doc_id", F.col("n").alias("n_candidates"), F.col("c").alias("n_confirmed"), (F.col("n") - F.col("c")).alias("n_unknown"), families.alias("families"), "best_score")
