"""License notices in texts, matched to templates.

Fingerprints of a template are the winnowed n-grams of its words; they form an
inverted index. Where a text holds fingerprints of the index, the words around
them are aligned with each template that they point to, within a band around
the diagonals that the fingerprints lie on. What is reported is the share of
the template that the alignment covers, and where.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.seeded import reference_words, regions, seeds_of, winnowed
from gleaner.llm.store import stored
from gleaner.operators.skew import at_most

N = 3
WINDOW = 2
"""A run of ``N + WINDOW - 1`` equal words always shares a fingerprint."""
SLACK = 4
BAND = 6
"""Words by which an alignment may leave the outermost diagonals of its fingerprints."""
LEAST = 0.8
"""Least share of a template's words that must be matched."""

# Public license notices, as they are put into files.
TEMPLATES = {
    "apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    "mit-short": "Released under the MIT License.",
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    "bsd-3-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met"),
    "gpl-3.0-short": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version."),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
}


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TEMPLATES.items()), "template string, text string")


def scan(docs: DataFrame, known: DataFrame, least: float = LEAST) -> DataFrame:
    """A row for each place of a text that matches a template.

    ``docs`` needs ``doc_id, text`` and ``known`` needs ``template, text``; other
    columns are ignored. Returns ``doc_id, template, coverage, n_equal,
    first_word, end_word``: the share of the template's words that the alignment
    finds in order, their number, and where they lie in the text, counted in
    words. Case and punctuation don't matter. A place may match several
    templates, when one holds the other; a template matches at most once in a
    region, but in any number of regions. Templates of fewer than ``N`` words
    and null texts match nothing. Rows that repeat an id with the same words around
    a notice give one row; rows without an id are left out.
    """
    docs, known = docs.where("doc_id is not null"), known.where("template is not null")
    references = stored(reference_words(known, "template", N, winnowed(WINDOW)))
    index = stored(seeds_of(references, "template"))
    n_index = index.count()
    sides = index.withColumn("before", F.col("ref_at")).withColumn("after", F.col("length") - F.col("ref_at") - N)
    found = regions(docs, sides, N, SLACK, winnowed(WINDOW))
    hits = found.select("doc_id", "at", "words", F.explode(F.arrays_zip("hits", "hit_ats")).alias("h"))
    diagonals = (hits.select("doc_id", "at", "words", F.col("h.hits").alias("gram"), (F.col("h.hit_ats") - F.col("at")).alias("hit_at"))
                 .join(at_most(index, n_index), "gram")
                 .groupBy("doc_id", "at", "words", "template", "length")
                 .agg(F.min(F.col("hit_at") - F.col("ref_at")).alias("low"), F.max(F.col("hit_at") - F.col("ref_at")).alias("high")))
    pairs = diagonals.join(at_most(references.select("template", F.size("words").alias("length"), F.col("words").alias("model")), n_index),
                           ["template", "length"]).select("doc_id", "template", "at", "words", "model", "low", "high")
    kind = dict(docs.dtypes)["doc_id"]
    return pairs.mapInArrow(_align(least), f"doc_id {kind}, template string, coverage double, n_equal int, first_word int, end_word int")


def _align(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                text, model = np.array(r["words"], np.int64), np.array(r["model"], np.int64)
                equal, first, end = banded(text, model, r["low"] - BAND, r["high"] + BAND)
                if equal >= least * len(model):
                    rows.append((r["doc_id"], r["template"], equal / len(model), equal, r["at"] + first, r["at"] + end))
            types = [batch.schema.field("doc_id").type, pa.string(), pa.float64(), *[pa.int32()] * 3]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)],
                                             names=["doc_id", "template", "coverage", "n_equal", "first_word", "end_word"])
    return run


def banded(text: np.ndarray, model: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """Most equal words in order, and their first and end place in the text.

    Only places whose offset from the template's word lies in ``low`` to ``high``
    are compared. Of equally good alignments the one that starts latest and ends first counts.
    """
    width = high - low + 1
    best = np.zeros(width + 2, np.int64)       # by diagonal, one more at either side
    start = np.full(width + 2, -1, np.int64)
    final = (0, 0, 0)
    for i, word in enumerate(model):
        places = i + low + np.arange(width)
        inside = (places >= 0) & (places < len(text))
        same = np.zeros(width, bool)
        same[inside] = text[places[inside]] == word
        # Along a diagonal a match adds one; skipping a template word comes from the next diagonal.
        taken = best[1:-1] + same
        begun = np.where(same & (start[1:-1] < 0), places, start[1:-1])
        skipped = best[2:]
        better = (skipped > taken) | ((skipped == taken) & (start[2:] > begun))
        row, row_start = np.where(better, skipped, taken), np.where(better, start[2:], begun)
        # Skipping words of the text comes from earlier diagonals of the same row.
        packed = np.maximum.accumulate(row * (1 << 32) + row_start + 1)
        best[1:-1], start[1:-1] = packed >> 32, (packed & ((1 << 32) - 1)) - 1
        for k in np.flatnonzero(same):
            if best[k + 1] > final[0]:
                final = (int(best[k + 1]), int(start[k + 1]), int(places[k]) + 1)
    return final
