"""License scans by MinHash bands over overlapping windows, verified by exact shingle containment.

Texts are cut into windows of `WINDOW` words, one every `STEP` words, so that any passage of `PIECE` words lies whole
in some window. Templates are cut into pieces of at most `PIECE` words. A window that holds a piece shares with it
at least (words of the piece - 4) of its own shingles; the number of bands is chosen so that the least such
similarity collides in some band with probability `CERTAIN`. Where a band collides, the template is
compared exactly: the share of its five-word shingles found within a stretch of its own length must reach `CONTAINED`.

Templates are constants of the library, a few KB, and go to every task.
"""

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pulsemill.llm.arrow_text import Words, pieces

SHINGLE = 5
PIECE = 10
STEP = 3
WINDOW = PIECE + STEP - 1
CERTAIN = 0.999
CONTAINED = 0.8
SEED = 11

# Wording of public license notices, by name.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at"
    ),
    "mit": "Released under the MIT License.",
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction"
    ),
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation"
    ),
    "bsd-header": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met"
    ),
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def band_settings(least: float, certain: float = CERTAIN) -> tuple[int, int]:
    """(rows of a band, bands): one row, and as many bands as make a collision at similarity `least` certain enough.

    Texts share hardly any five-word shingle with a template by chance, so longer bands would only cost
    certainty.
    """
    return 1, math.ceil(math.log(1 - certain) / math.log(1 - least))


@dataclass
class Templates:
    names: list[str]
    shingles: list[np.ndarray]  # sorted hashes of each template
    words: list[int]
    factors: np.ndarray  # odd multipliers, one by band
    bands: list[np.ndarray]  # sorted MinHash values of the pieces, by band
    owners: list[list[tuple[int, ...]]]  # templates with that value


def _least_hashes(h: np.ndarray, starts: np.ndarray, factor: np.uint64) -> np.ndarray:
    mixed = h * factor
    mixed ^= mixed >> np.uint64(31)
    return np.minimum.reduceat(mixed, starts)


def build(templates: dict[str, str] = TEMPLATES, certain: float = CERTAIN, seed: int = SEED) -> Templates:
    names = sorted(templates)
    words = Words(pa.array([templates[n] for n in names]))
    at, h = words.shingles(SHINGLE)
    doc = words.doc[at]
    lengths = np.diff(words.first)
    if len(names) and lengths.min() < SHINGLE:
        raise ValueError(f"a template needs {SHINGLE} words")
    parts = []  # (template, its shingles of one piece)
    for k, n in enumerate(lengths):
        own = h[doc == k]
        last = max(0, n - PIECE)
        for a in sorted({*range(0, last + 1, PIECE), last}):
            parts.append((k, own[a : a + min(n, PIECE) - SHINGLE + 1]))
    least = min((len(p) / (WINDOW - SHINGLE + 1) for _, p in parts), default=1.0)
    _, bands = band_settings(min(least, 0.999), certain)
    factors = np.random.default_rng(seed).integers(0, 1 << 63, bands, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    values, owners = [], []
    for factor in factors:
        table: dict[int, set[int]] = {}
        for k, part in parts:
            table.setdefault(int(_least_hashes(part, np.zeros(1, np.int64), factor)[0]), set()).add(k)
        values.append(np.array(sorted(table), np.uint64))
        owners.append([tuple(sorted(table[v])) for v in sorted(table)])
    return Templates(names, [np.unique(h[doc == k]) for k in range(len(names))], lengths.tolist(), factors, values, owners)


def _licenses(words: Words, t: Templates) -> list[list[dict]]:
    """Verified templates of each text, with first and last word and containment."""
    out: list[list[dict]] = [[] for _ in range(len(words.offsets) - 1)]
    at, h = words.shingles(SHINGLE)
    if not len(at):
        return out
    # Windows begin at every STEP-th shingle of a text and hold WINDOW words, fewer at its end.
    doc = words.doc[at]
    first = np.searchsorted(doc, np.arange(len(out)))
    starts = np.flatnonzero((np.arange(len(at)) - first[doc]) % STEP == 0)
    wide = WINDOW - SHINGLE + 1
    ends = np.minimum(starts + wide, np.searchsorted(doc, doc[starts], side="right"))
    bounds = np.stack([starts, ends], axis=1).ravel()
    padded = np.append(h, np.uint64(0))  # reduceat needs an end inside; the odd results are not used
    retrieved = set()
    for factor, values, owners in zip(t.factors, t.bands, t.owners):
        low = _least_hashes(padded, bounds, factor)[::2]
        place = np.minimum(np.searchsorted(values, low), len(values) - 1)
        for window in np.flatnonzero(values[place] == low):
            retrieved |= {(int(doc[starts[window]]), k) for k in owners[place[window]]}
    for d, k in sorted(retrieved):
        a, b = int(first[d]), int(np.searchsorted(doc, d, side="right"))
        own = t.shingles[k]
        hits = a + np.flatnonzero(np.isin(h[a:b], own))
        done = -1
        reach = t.words[k] - SHINGLE + 1
        for p in hits:
            if p <= done:
                continue
            some = hits[np.searchsorted(hits, p) : np.searchsorted(hits, p + reach)]
            share = len(np.unique(h[some])) / len(own)
            if share >= CONTAINED:
                done = p + reach - 1
                out[d].append({"name": t.names[k], "start": int(p - a), "end": int(some[-1] - a) + SHINGLE, "containment": share})
    return out


_FOUND = "array<struct<name: string, start: int, end: int, containment: double>>"
_ARROW_FOUND = pa.list_(pa.struct([("name", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("containment", pa.float64())]))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """License notices in every document row.

    docs: doc_id, text; other columns are ignored. Returns doc_id, text_key (xxhash64 of the text) and found: name,
    first and last word (exclusive) and containment of each notice, by name and place. Overlapping templates are
    all reported, one template not twice at overlapping places. NULL, empty and texts of fewer than five words have none;
    repeated rows give repeated rows.
    """
    table = docs.sparkSession.sparkContext.broadcast(build(templates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = _licenses(Words(batch.column("text")), table.value) if table.value.names else [[]] * batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(found, _ARROW_FOUND)], names=["doc_id", "text_key", "found"]
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    return rows.mapInArrow(run, f"doc_id bigint, text_key bigint, found {_FOUND}")
