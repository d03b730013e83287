"""Licence scans: TF-IDF cosine of headers and licence files to templates, then inheritance along directories."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.decontaminate import words
from tessera.llm.shared import materialize

#: Licence names and sentences by which files state them.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "This software is licensed under the MIT license."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 1.0 Universal public domain dedication."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
LEAST_COSINE = 0.75
LICENSE_FILE = re.compile(r"(?i)(?:licen[cs]es?|copying|unlicense)(?:[.\-_][a-z0-9.\-_]*)?$")
FAN_IN = 16
#: Parts into which the rows of one directory are dealt when they meet its licence.
SALTS = 32
#: Marks of comments at either end of a line.
_COMMENT = re.compile(r"(?m)^[ \t]*(?:/\*+|\*+/?|//+!?|#+|--+|;+|%+|<!--|dnl\b|REM\b|\"\"\")?[ \t]*|[ \t]*(?:\*+/|-->)?[ \t\r]*$")
_VOCABULARY = sorted({w for _, text in TEMPLATES for w in words(text)})


def document_frequencies(files: DataFrame, text_col: str) -> tuple[int, dict[bytes, int]]:
    """Rows, and for each word of the templates the rows that hold it; partitions and groups of them add up first."""
    known = set(_VOCABULARY)

    def partial(batches):
        from pyspark import TaskContext

        n, found = 0, Counter()
        for batch in batches:
            n += batch.num_rows
            for text in batch.column(0):
                found.update(known.intersection(words(text.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % FAN_IN] * (len(found) + 1), pa.int32()), pa.array([b"", *found], pa.binary()), pa.array([n, *found.values()], pa.int64())], names=["g", "word", "n"])

    counts = files.select(F.col(text_col).cast("string").alias("text")).mapInArrow(partial, "g int, word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # no more rows than the templates have words
    out = {bytes(r["word"]): r["n"] for r in counts}
    return out.pop(b"", 0), out


class Matcher:
    """Sparse TF-IDF vectors of the templates, and an exact filter by the words without which no cosine is high enough."""

    def __init__(self, n: int, frequencies: dict[bytes, int]):
        self.weight = {w: 1.0 + math.log((n + 1) / (frequencies.get(w, 0) + 1)) for w in _VOCABULARY}
        self.unknown = 1.0 + math.log(n + 1)
        self.templates, self.vectors, self.postings, self.signal = [], [], {}, set()
        for k, (name, text) in enumerate(TEMPLATES):
            vector = {w: c * self.weight[w] for w, c in Counter(words(text)).items()}
            norm = math.sqrt(sum(x * x for x in vector.values()))
            self.templates.append((name, norm))
            self.vectors.append((sum(Counter(words(text)).values()), vector))
            low = 0.0
            for w, x in sorted(vector.items(), key=lambda p: (p[1], p[0])):
                self.postings.setdefault(w, []).append((k, x))
                low += x * x
                if math.sqrt(low) >= LEAST_COSINE * norm * (1 - 1e-9):  # the lighter words alone can't reach the cosine
                    self.signal.add(w)

    def best(self, own: list[bytes], only: int | None = None) -> tuple[float, str] | None:
        """The template with the highest cosine, or the only one that is asked for, if that is high enough."""
        counts = Counter(own)
        if self.signal.isdisjoint(counts):
            return None
        dots: dict[int, float] = {}
        total = 0.0
        for w, c in counts.items():
            x = c * self.weight.get(w, self.unknown)
            total += x * x
            for k, y in self.postings.get(w, ()):
                if only is None or k == only:
                    dots[k] = dots.get(k, 0.0) + x * y
        cosine, k = max(((d / (self.templates[k][1] * math.sqrt(total)), -k) for k, d in dots.items()), default=(0.0, 0))
        return (cosine, self.templates[-k][0]) if cosine >= LEAST_COSINE else None

    def windows(self, own: list[bytes]) -> list[tuple[int, list[bytes]]]:
        """(template, run of own as long as it) where the run can reach the cosine with it; none that can is left out."""
        out, weight = [], self.weight
        square = np.concatenate(([0.0], np.cumsum([weight.get(w, self.unknown) ** 2 for w in own])))
        for k, ((_, norm), (size, vector)) in enumerate(zip(self.templates, self.vectors, strict=True)):
            n = min(size, len(own))
            dot = np.concatenate(([0.0], np.cumsum([vector.get(w, 0.0) * weight.get(w, 0.0) for w in own])))
            # a vector is at least as long as its words would be if all were different
            able = dot[n:] - dot[: len(dot) - n] >= LEAST_COSINE * norm * np.sqrt(square[n:] - square[: len(square) - n]) * (1 - 1e-9) - 1e-9
            out += [(k, own[i : i + n]) for i in np.flatnonzero(able & (dot[n:] > dot[: len(dot) - n])).tolist()]
        return out

    def scan(self, text: str | None) -> tuple[float, str] | None:
        """The best licence of any line, sentence-like part, paragraph, the whole of the text, or run of words; ties: the first found.

        Comment marks are taken off and lines joined before sentences, and runs as long as a template with that one, are
        compared.
        """
        if not text or self.signal.isdisjoint(words(text)):
            return None
        parts = text.split("\n")
        parts += [s for line in parts for s in re.split(r"(?<=[.;])\s+", line) if s != line]
        parts += re.split(r"\n\s*\n", text)
        found = None
        joined = " ".join(_COMMENT.sub("", text).split())
        parts += [joined, *re.split(r"(?<=[.;])\s+", joined)]
        runs = [(None, words(part)) for part in dict.fromkeys(parts)]
        for only, own in [*runs, *self.windows(words(joined))]:
            got = self.best(own, only)
            if got and (found is None or got[0] > found[0] + 1e-12):
                found = got
        return found


def scan_licenses(files: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, cosine, origin) of each row of files.

    origin own: the text states it. origin inherited: the nearest directory at or above the file's that has a licence
    file (LICENSE, COPYING and the like, by the last part of the path) states it; several such files of a directory:
    the highest cosine, then the first name. Otherwise all three are null. Null and empty texts state nothing; a null
    path and a row with a null id inherit nothing. Repeated ids are rows of their own. Whole texts are scanned, however
    long. Of files only id_col, text_col and the path are read, so other columns can have any names. No rows: none out.
    """
    n, frequencies = document_frequencies(files, text_col)

    def run(batches):
        matcher = Matcher(n, frequencies)
        for batch in batches:
            found = [matcher.scan(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f and f[1] for f in found], pa.string()), pa.array([f and f[0] for f in found], pa.float64())], names=["doc_id", "path", "license", "cosine"])

    own = materialize(files.select(F.col(id_col).cast("long").alias("id"), path.cast("string").alias("path"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, path string, license string, cosine double"), "own-licenses")
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    own = own.withColumn("folder", folder)
    stated = own.where("license is not null").where(F.regexp_extract("path", "([^/]*)$", 1).rlike("^" + LICENSE_FILE.pattern))
    stated = stated.groupBy("folder").agg(F.min_by(F.struct("license", "cosine"), F.struct((-F.col("cosine")).alias("a"), F.col("license").alias("b"))).alias("given")).withColumnRenamed("folder", "above")
    # Each directory once, with its ancestors; the deepest that has a licence file wins.
    folders = own.where("license is null and folder is not null").select("folder").distinct()
    parts = F.split("folder", "/")
    chain = folders.withColumn("above", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")))).distinct()
    nearest = chain.join(stated, "above").groupBy("folder").agg(F.max_by("given", F.length("above")).alias("given")).withColumnRenamed("folder", "__folder")
    salted = own.withColumn("salt", F.pmod(F.xxhash64("doc_id", "path"), F.lit(SALTS)).cast("int"))
    nearest = nearest.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = salted.join(nearest, (salted["folder"] == nearest["__folder"]) & (salted["salt"] == nearest["__salt"]), "left")
    inherits = F.col("license").isNull() & F.col("given").isNotNull() & F.col("doc_id").isNotNull()
    return joined.select(
        "doc_id",
        F.when(inherits, F.col("given.license")).otherwise(F.col("license")).alias("license"),
        F.when(inherits, F.col("given.cosine")).otherwise(F.col("cosine")).alias("cosine"),
        F.when(F.col("license").isNotNull(), "own").when(inherits, "inherited").alias("origin"),
    )


#: Documents of one directory in the query, by id.
FOLDER_IDS = 100


def document_path(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """source/language/hundred/id; a document that speaks of a licence is a licence file of its folder, LICENSE.id."""
    folder = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), F.floor(F.col(id_col) / FOLDER_IDS).cast("string"))
    speaks = F.coalesce(F.col(text_col).rlike("(?i)licen[cs]e|public domain"), F.lit(False))
    return F.concat(folder, F.when(speaks, F.lit("/LICENSE.")).otherwise(F.lit("/")), F.col(id_col).cast("string"))


def op10_licenses(spark, sf_dir: str) -> DataFrame:
    """All documents, those that state a licence being their folder's licence files, which the folder's others inherit."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan_licenses(docs, document_path())
