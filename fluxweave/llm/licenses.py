"""License scans by diagonal voting: k-gram hashes of the words joined to template positions, votes by offset, merged and verified."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ALNUM_BYTES, buffers, chunks, grams, text_hash, words, words_of
from .common import spans as words_at

# The base phrases and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Wording of public license notices.
NOTICES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "apache": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    "cc-by": "This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/",
    "cc-by-sa": "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/",
}

#: Words in a gram of a base phrase and of a notice.
PHRASE_K, NOTICE_K = 2, 4
#: Parts of a notice belong together if their diagonals differ by this share of its words, or SLACK words, at most: so many words may be put in or left out.
STRETCH, SLACK = 0.5, 8
#: Least share of a notice's grams that a verified span has, in their order.
COVERAGE = 0.5


def _entries(phrases: dict[str, str], notices: dict[str, str]) -> list[tuple]:
    out = []
    for exact, k, texts in ((True, PHRASE_K, phrases.items()), (False, NOTICE_K, [(text, label) for label, text in notices.items()])):
        for text, label in texts:
            hashes = words_of(text)
            found = grams(hashes, np.array([0, len(hashes)]), k)[0]
            out += [(f"{label}/{k}/{len(hashes)}", label, exact, len(found), p, int(h)) for p, h in enumerate(found.view(np.int64))]
    return out


def templates(spark: SparkSession, phrases: dict[str, str] = BASE_PHRASES, notices: dict[str, str] = NOTICES) -> DataFrame:
    """A row for each gram of each template: as large as the fixed texts above, so it can be broadcast."""
    return spark.createDataFrame(_entries(phrases, notices), "template string, label string, exact boolean, n_grams int, at int, gram long")


def _rolling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = buffers(batch.column("text"))
        for a, b in chunks(offsets):
            hashes, _, _, ptr = words(data, offsets[a : b + 1], ALNUM_BYTES)
            for k in (PHRASE_K, NOTICE_K):
                found, at = grams(hashes, ptr, k)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], batch.column("text_hash")[a:b], pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(found.view(np.int64)))], ["doc_id", "text_hash", "grams"])


def votes(documents: DataFrame, phrases: dict[str, str] = BASE_PHRASES, notices: dict[str, str] = NOTICES) -> DataFrame:
    """Diagonals with votes: doc_id, text_hash, template, label, exact, n_grams, diagonal (text position minus template position) and the template positions seen on it."""
    kind = dict(documents.dtypes)["doc_id"]
    rolling = documents.select("doc_id", "text", text_hash().alias("text_hash")).mapInArrow(_rolling, f"doc_id {kind}, text_hash long, grams array<long>")
    hits = rolling.select("doc_id", "text_hash", F.posexplode("grams").alias("pos", "gram")).join(F.broadcast(templates(documents.sparkSession, phrases, notices)), "gram")
    return hits.groupBy("doc_id", "text_hash", "template", "label", "exact", "n_grams", (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.collect_set("at").alias("seen"))


def _in_order(seen: list[dict]) -> tuple[int, int, int]:
    """Of hits (diagonal, template positions): the longest chain that ascends in the template and in the text; its length, first and past-last text position."""
    hits = sorted((at, -(part["diagonal"] + at)) for part in seen for at in part["seen"])
    tails, ends, back = [], [], []  # a template position's later places come first, so that a chain takes one of them
    for n, (_, minus) in enumerate(hits):
        k = bisect_left(tails, -minus)
        back.append(ends[k - 1] if k else -1)
        tails[k : k + 1], ends[k : k + 1] = [-minus], [n]
    n = ends[-1]
    while back[n] >= 0:
        n = back[n]
    return len(tails), -hits[n][1], tails[-1] + 1


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([_in_order(x) for x in batch.column("parts").to_pylist()], np.int32).reshape(-1, 3)
        rest = batch.drop_columns(["parts"])
        yield pa.RecordBatch.from_arrays([*rest.columns, *map(pa.array, found.T)], [*rest.schema.names, "n_found", "start", "last"])


def spans(documents: DataFrame, phrases: dict[str, str] = BASE_PHRASES, notices: dict[str, str] = NOTICES) -> DataFrame:
    """Verified spans: doc_id, text_hash, template, label, exact, start and end (words, end exclusive), coverage (0 to 1).

    A phrase is verified where one diagonal has all its grams: its words stand there consecutively. For a notice,
    each diagonal opens a window of the diagonals up to STRETCH of its words on; it is verified where a chain of its
    grams within the window, in order in text and notice, has COVERAGE of them. Of windows that lie so near to each
    other the one of greatest coverage stays, the shortest, then the first. However many diagonals follow on each
    other, none is dropped: only the window's width, not the chain of neighbours, decides.
    """
    found = votes(documents, phrases, notices)
    whole = found.where(F.col("exact") & (F.size("seen") == F.col("n_grams"))).select("doc_id", "text_hash", "template", "label", "exact", F.col("diagonal").alias("start"), (F.col("diagonal") + F.col("n_grams") + PHRASE_K - 1).alias("end"), F.lit(1.0).alias("coverage"))
    parts = found.where(~F.col("exact")).withColumn("cell", F.col("diagonal") / F.greatest(F.lit(float(SLACK)), F.col("n_grams") * STRETCH))
    near = Window.partitionBy("doc_id", "text_hash", "template").orderBy("cell")
    opened = parts.withColumn("votes", F.sum(F.size("seen")).over(near.rangeBetween(0, 1))).withColumn("parts", F.collect_list(F.struct("diagonal", "seen")).over(near.rangeBetween(0, 1)))
    likely = opened.where(F.col("votes") >= COVERAGE * F.col("n_grams")).select("doc_id", "text_hash", "template", "label", "exact", "n_grams", "cell", "parts")
    kind = dict(documents.dtypes)["doc_id"]
    chained = likely.mapInArrow(_chained, f"doc_id {kind}, text_hash long, template string, label string, exact boolean, n_grams int, cell double, n_found int, start int, last int")
    chained = chained.where(F.col("n_found") >= COVERAGE * F.col("n_grams")).withColumn("rank", F.struct("n_found", F.col("start") - F.col("last"), -F.col("cell")))
    best = chained.withColumn("best", F.max("rank").over(near.rangeBetween(-1, 1))).where("rank = best")
    merged = best.select("doc_id", "text_hash", "template", "label", "exact", "start", (F.col("last") + NOTICE_K - 1).alias("end"), (F.col("n_found") / F.col("n_grams")).alias("coverage"))
    return whole.unionByName(merged)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = buffers(batch.column("text"))
        n = [np.diff(np.append(ptr, len(starts))[: b - a + 1]) for a, b in chunks(offsets) for starts, _, ptr in [words_at(data, offsets[a : b + 1], ALNUM_BYTES)]]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(np.concatenate([np.zeros(0, np.int64), *n]))], ["doc_id", "text_hash", "n_words"])


def _joined(of: Column) -> Column:
    return F.array_join(F.array_sort(F.collect_set(of)), ",")


def scan(documents: DataFrame, phrases: dict[str, str] = BASE_PHRASES, notices: dict[str, str] = NOTICES) -> DataFrame:
    """One row for each row of documents: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score: 1 with a base phrase, else the largest coverage of a verified notice, else 0. A null text counts as
    empty: no words, no labels (''), first_word and last_word null. Repeated rows are told apart by nothing and get
    equal results; rows that share an id but not the text get results of their own; a null id is kept. Only doc_id
    and text are read, so other columns cannot clash.
    """
    base = F.col("exact")
    of_text = spans(documents, phrases, notices).groupBy("doc_id", "text_hash").agg(
        F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"), F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        _joined(F.when(base, F.col("label"))).alias("base_labels"), _joined(F.col("label")).alias("labels"), F.max("coverage").alias("score"),
    )
    counted = documents.select("doc_id", "text", text_hash().alias("text_hash")).mapInArrow(_counted, f"doc_id {dict(documents.dtypes)['doc_id']}, text_hash long, n_words long")
    same = counted.doc_id.eqNullSafe(of_text.doc_id) & (counted.text_hash == of_text.text_hash)
    return counted.join(of_text, same, "left").select(
        counted.doc_id, "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
