"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

A template of t shingles is looked for in windows of twice its size class (the power of two from t on), one every size
class shingles, so that each occurrence lies whole in one window. Windows without any shingle of a template have
containment 0 and are not made. The shingles of a window are hashed BANDS times; each least value is a band of one row.
A window is at most four times as long as the template, so one that contains the share c of it has at least the Jaccard
similarity s = c / (5 - c) with it, and agrees in at least one band with probability 1 - (1 - s) ** BANDS: above 0.9999
at c = 0.8. Templates so retrieved are verified by exact containment of their shingles. Templates that share most of
their words are all reported, each with its own containment; `best` marks those that fit a window best.

All of it runs in DataFrame functions. Any number of templates may be given (see native.found_places).

Defined cases: null or empty texts and templates match nothing; a template of fewer than five words is one shingle of all
its words. Repeated rows and ids give their rows once; a null id is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gnomon.llm import common as C
from gnomon.llm import native as V

N, PERCENT, BANDS = 5, 80, 48

#: Short notices by which files name their license.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("proprietary", "All rights reserved."),
]


def notices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(NOTICES)], "template_id long, license string, text string")


def scan(docs: DataFrame, templates: DataFrame, n: int = N, percent: int = PERCENT, bands: int = BANDS, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, template_id, license, containment, windows (how many windows hold the template), best (whether in one of them no
    other template is contained to a greater part)."""
    templates = templates.where(F.col("template_id").isNotNull())
    folder = C.shared_dir(docs.sparkSession)
    shingles = C.written(V.pattern_shingles(templates, "template_id", "text", n), f"{folder}/shingles")
    docs = docs.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = V.found_places(docs, ["doc_id"], "text", shingles)
    # The size class of the template and the two windows that the place lies in.
    stride = F.pow(F.lit(2), F.ceil(F.log2(F.col("many") - F.col("size") + 1))).cast("int")
    rows = rows.withColumn("stride", stride).withColumn("number", F.floor((F.col("at") - 1) / F.col("stride")).cast("int"))
    spots = rows.select("doc_id", "words", "stride", "size", F.explode(F.array("number", F.col("number") - 1)).alias("number")).where("number >= 0")
    windows = spots.select("doc_id", "stride", "size", "number", F.slice("words", F.col("number") * F.col("stride") + 1, 2 * F.col("stride") + F.col("size") - 1).alias("window"))
    windows = windows.withColumn("key", F.sha2(F.concat_ws(" ", "window"), 256))
    # Written, as they are read three times: the texts are searched once.
    owners = C.written(windows.groupBy("doc_id", "stride", "size", "number", "key").agg(F.first("window").alias("window")), f"{folder}/windows")
    distinct = owners.groupBy("key", "size", "stride").agg(F.first("window").alias("window"))
    grams = V.held(distinct, "h", F.transform("window", lambda w: F.xxhash64(w)))
    spread = grams.select("key", "size", "stride", "h", F.explode(V.places(F.col("h"), F.col("size"))).alias("i"))
    ours = spread.select("key", "size", "stride", V.shingle(F.col("h"), F.col("i"), n, F.col("size")).alias("sh")).distinct()
    theirs = shingles.withColumn("stride", stride).select("template_id", "size", "stride", "sh").distinct()
    least = [F.min(F.xxhash64("sh", F.lit(b))).alias(f"m{b}") for b in range(bands)]
    banded = lambda df, key: df.groupBy(key, "size", "stride").agg(*least).select(key, "size", "stride", F.posexplode(F.array(*[f"m{b}" for b in range(bands)])).alias("band", "value"))
    got = banded(ours, "key").join(F.broadcast(banded(theirs, "template_id")), ["size", "stride", "band", "value"]).select("key", "template_id", "size", "stride").distinct()
    whole = theirs.groupBy("template_id").agg(F.count("*").alias("total"))
    both = got.join(ours, ["key", "size", "stride"]).join(F.broadcast(theirs), ["template_id", "size", "stride", "sh"]).groupBy("key", "size", "stride", "template_id").agg(F.count("*").alias("both"))
    true = both.join(F.broadcast(whole), "template_id").where(100 * F.col("both") >= percent * F.col("total")).select("key", "size", "stride", "template_id", (F.col("both") / F.col("total")).alias("containment"))
    top = true.groupBy("key", "size", "stride").agg(F.max("containment").alias("top"))
    true = true.join(top, ["key", "size", "stride"]).withColumn("best", F.col("containment") == F.col("top")).drop("top")
    named = true.join(F.broadcast(templates.select("template_id", "license")), "template_id")
    return owners.select("doc_id", "key", "size", "stride", "number").join(named, ["key", "size", "stride"]).groupBy("doc_id", "template_id", "license").agg(F.round(F.max("containment"), 6).alias("containment"), F.count("*").alias("windows"), F.max("best").alias("best"))
