"""License scans: MinHash bands over overlapping windows of a text retrieve templates, containment verifies them.

Templates are put into classes by their number of shingles. A class of up to `l` shingles reads a text in windows of
three blocks of l/2, so that every run of l shingles lies inside some window. A window that holds SHARE of a template
has a Jaccard similarity of at least 0.38 to it (SHARE / (1.5 * STEP + 1 - SHARE)), so that of BANDS bands of one row
each, at least one agrees with a probability of 0.9995 or more; for a template that is there word by word, of 0.99999.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profspark.llm.scratch import narrowed, packed, row_and, unpacked
from profspark.llm.words import ALNUM, U64, encoded, windows, words

SHINGLE, SHARE, STEP, BANDS = 5, 0.8, 1.25, 16
#: Templates are sent to every executor; more than this many words of them are refused.
MOST_WORDS = 2_000_000
PIECE = 1 << 14
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "mit": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
MATCH = "array<struct<template: string, containment: double, first: long, last: long>>"


class Template(NamedTuple):
    name: str
    shingles: np.ndarray


def block_size(count: int) -> int:
    """Half the size of the class that `count` shingles belong to, rounded up."""
    size = 1
    while size < count:
        size = max(size + 1, int(size * STEP))
    return -(-size // 2)


class Index:
    """Templates by shingle size and block size, with the least value of each hash function."""

    def __init__(self, templates: dict[str, str], size: int = SHINGLE, bands: int = BANDS):
        rng = np.random.default_rng(5)
        self.factor = rng.integers(0, 1 << 63, bands, dtype=np.int64).view(U64) * U64(2) + U64(1)
        classes: dict[tuple[int, int], list[Template]] = {}
        for name, text in sorted(templates.items()):
            h = words(encoded(text), ALNUM)[0]
            if len(h):
                k = min(size, len(h))
                own = np.unique(windows(h, k))
                classes.setdefault((k, block_size(len(h) - k + 1)), []).append(Template(name, own))
        self.classes = {key: (own, [(t.shingles * self.factor[:, None]).min(axis=1) for t in own]) for key, own in classes.items()}

    def least(self, s: np.ndarray, block: int) -> np.ndarray:
        """For each hash function and each window of three blocks, the least value; a few thousand blocks at a time."""
        step = block * (1 + PIECE // block)
        parts = [np.minimum.reduceat(s[a : a + step] * self.factor[:, None], np.arange(0, min(step, len(s) - a), block), axis=1) for a in range(0, len(s), step)]
        low = parts[0] if len(parts) == 1 else np.concatenate(parts, axis=1)
        out = low.copy()
        for shift in (1, 2):
            np.minimum(out[:, :-shift], low[:, shift:], out=out[:, :-shift])
        return out

    def matches(self, h: np.ndarray, share: float) -> list[tuple[str, float, int, int]]:
        out, shingles = [], {k: windows(h, k) for k, _ in self.classes}
        for (k, block), (templates, values) in self.classes.items():
            s = shingles[k]
            if len(s):
                low = self.least(s, block)
                for t, v in zip(templates, values, strict=True):
                    at = np.flatnonzero((low == v[:, None]).any(axis=0))
                    if len(at):
                        out += _verified(s, k, block, t, at.tolist(), share)
        return sorted(out)


def _verified(s: np.ndarray, k: int, block: int, template: Template, at: list[int], share: float) -> list[tuple[str, float, int, int]]:
    """Places where windows hold enough of the template; windows that overlap make one place."""
    places: list[list] = []
    for w in at:
        own = s[w * block : (w + 3) * block]
        hit = np.flatnonzero(np.isin(own, template.shingles))
        if len(np.unique(own[hit])) >= share * len(template.shingles) - 1e-9:
            hit = hit + w * block
            if places and hit[0] <= places[-1][-1]:
                places[-1] = np.union1d(places[-1], hit).tolist()
            else:
                places.append(hit.tolist())
    return [(template.name, len(np.unique(s[p])) / len(template.shingles), p[0], p[-1] + k - 1) for p in places]


def scanned(df: DataFrame, templates: dict[str, str] = TEMPLATES, text_col: str = "text", share: float = SHARE, keep: list[str] | None = None) -> DataFrame:
    """`df` (or its columns `keep`) with n_words and matches, which replace columns of the same names.

    matches: template, the share of its distinct shingles that is there, and the first and last word, counted from 0;
    sorted. Words are in lower case, of ASCII letters, digits and characters beyond ASCII; shingles have five words, or
    all words of a shorter template. Null and empty texts have none, templates without words match nothing. Every row
    stands for itself, repeated ones, too.
    """
    if sum(len(t.split()) for t in templates.values()) > MOST_WORDS:
        raise ValueError(f"templates have more than {MOST_WORDS} words; scan for them in several calls")
    index = df.sparkSession.sparkContext.broadcast(Index(templates))
    kind = pa.list_(pa.struct([("template", pa.string()), ("containment", pa.float64()), ("first", pa.int64()), ("last", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, matches = [], []
            for t in batch["text"].cast(pa.binary()):
                h = words(t.as_py() or b"", ALNUM)[0]
                n.append(len(h))
                matches.append([dict(zip(("template", "containment", "first", "last"), m, strict=True)) for m in index.value.matches(h, share)])
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(n, pa.int64()), pa.array(matches, kind)], names=["row", "n_words", "matches"])

    rows = narrowed(packed(df, text=F.col(text_col)), keep)
    return unpacked(rows.mapInArrow(run, row_and(rows, f"n_words long, matches {MATCH}")), "n_words", "matches")
