"""Periodic runs of words, by a dictionary of basic factors.

A run is a stretch of words with smallest period q, at least `least` and 2 * q words long, that no neighbouring word
extends with period q. For each power of two m the dictionary names the factors of m words, so that equal factors have
equal names; a name of 2 * m words is a pair of names of m words, and positions whose factor is the only one of its name
go, because no longer factor there can come twice either.

A run of period q with m <= q < 2 * m has its first factor of m words again q words later, which is less than 2 * m. So
for each name, successor occurrences within that distance propose all periods:

* Successors at most m / 2 apart all have one distance p, the factor's own period. They are one arithmetic progression;
  their period was proposed with shorter factors.
* Progressions (or single occurrences) of one name are more than m / 2 apart, so that three of them at most follow
  within 2 * m. Differences between the members of two are again an arithmetic progression with step p, of at most
  2 * m / p periods. Members that propose one period overlap, so that one of them stands for all.

The shortest factors, of 4 words, propose all periods below 8, since a run has at least 12 words. Each proposal is
extended to both sides. Proposals of one run meet in the same stretch, and multiples of a period too; the smallest
period of a stretch stays. The work is in the order of n * log(n) words, with memory for a batch of texts, or for the
longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profspark.llm.scratch import narrowed, packed, row_and, unpacked
from profspark.llm.words import encoded

LEAST = 12
SHORTEST = 4
#: Words that are looked at together, unless one text has more; and words compared in one step of an extension.
TOGETHER = 1 << 18
COMPARED = 1 << 22


def numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word, and where each text starts. Equal words of one text have equal numbers, others never.

    A number of its own stands after each text, so that nothing reaches from one text into the next.
    """
    numbers, starts, top = [-1], [], 0
    for words in texts:
        starts.append(len(numbers))
        own: dict[bytes, int] = {}
        numbers += [own.setdefault(w, len(own)) + top for w in words]
        numbers.append(top + len(own))
        top += len(own) + 1
    return np.array(numbers, dtype=np.int64), np.array(starts, dtype=np.int64)


def _shared(key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names and positions, sorted by both, of what occurs at least twice; names are dense numbers."""
    order = np.argsort(key, kind="stable")
    key, at = key[order], at[order]
    same = key[1:] == key[:-1]
    twice = np.zeros(len(key), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    key, at = key[twice], at[twice]
    return np.cumsum(np.concatenate(([0], key[1:] != key[:-1]))[: len(key)]), at


def factors(numbers: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(m, names, positions) for each power of two, shared factors only, sorted by name and position."""
    m, (name, at) = 1, _shared(numbers, np.arange(len(numbers)))
    of = np.full(len(numbers), -1, dtype=np.int64)
    while len(at):
        yield m, name, at
        of[:] = -1
        of[at] = name
        at = np.sort(at)
        at = at[: np.searchsorted(at, len(numbers) - m)]
        at = at[of[at + m] >= 0]
        name, at = _shared(of[at] * (int(name[-1]) + 1) + of[at + m], at)
        m *= 2


def _proposed(m: int, name: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and periods: words there repeat, for m words at least, that many words later."""
    low = 1 if m == SHORTEST else m
    gap = at[1:] - at[:-1]
    joined = (name[1:] == name[:-1]) & (2 * gap <= m)
    head = np.flatnonzero(np.concatenate(([True], ~joined)))
    tail = np.concatenate((head[1:], [len(at)])) - 1
    first, last, step = at[head], at[tail], np.zeros(len(head), dtype=np.int64)
    many = tail > head
    step[many] = gap[head[many]]
    places, periods = [], []
    if m == SHORTEST:
        places.append(first[many])
        periods.append(step[many])
    for ahead in (1, 2, 3):
        x, y = slice(None, -ahead), slice(ahead, None)
        near = np.flatnonzero((name[head[x]] == name[head[y]]) & (first[y] - last[x] < 2 * m))
        if not len(near):
            break
        a, b = near, near + ahead
        p = np.maximum(np.maximum(step[a], step[b]), 1)
        start = first[b] - last[a]
        start += np.maximum(0, -((start - low) // p)) * p
        number = np.maximum(0, (np.minimum(last[b] - first[a], 2 * m - 1) - start) // p + 1)
        pair = np.repeat(np.arange(len(near)), number)
        nth = np.arange(len(pair)) - np.repeat(np.cumsum(number) - number, number)
        q = start[pair] + nth * p[pair]
        places.append(np.maximum(first[a[pair]], first[b[pair]] - q))
        periods.append(q)
    if not places:
        return at[:0], at[:0]
    i, q = np.concatenate(places), np.concatenate(periods)
    order = np.lexsort((i, q))
    i, q = i[order], q[order]
    # Places of one period whose repeated words touch are in one run.
    new = np.ones(len(i), dtype=bool)
    new[1:] = (q[1:] != q[:-1]) | (i[1:] - i[:-1] > m)
    return i[new], q[new]


def _reach(numbers: np.ndarray, i: np.ndarray, j: np.ndarray, way: int) -> np.ndarray:
    """How many words from i and j on are the same, to the right (way 1) or to the left (-1)."""
    out, open_, width = np.zeros(len(i), dtype=np.int64), np.arange(len(i)), 16
    while len(open_):
        still = []
        for k in range(0, len(open_), max(1, COMPARED // width)):
            part = open_[k : k + max(1, COMPARED // width)]
            along = way * np.arange(width)
            x, y = (np.clip(at[part, None] + way * out[part, None] + along, 0, len(numbers) - 1) for at in (i, j))
            differ = (numbers[x] != numbers[y]) | (x == y)
            found = differ.any(axis=1)
            out[part] += np.where(found, differ.argmax(axis=1), width)
            still.append(part[~found])
        open_ = np.concatenate(still)
        width = min(2 * width, 1 << 16)
    return out


def runs(numbers: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (start, length, period), sorted by start and period; `least` is at least 12."""
    found = [np.empty((0, 3), dtype=np.int64)]
    for m, name, at in factors(numbers):
        if m < SHORTEST:
            continue
        i, q = _proposed(m, name, at)
        if len(i):
            left = _reach(numbers, i - 1, i + q - 1, -1)
            found.append(np.stack([i - left, left + q + _reach(numbers, i, i + q, 1), q], axis=1))
    rows = np.concatenate(found)
    rows = rows[rows[:, 1] >= np.maximum(least, 2 * rows[:, 2])]
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    rows = rows[new]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def of_texts(texts: list[list[bytes]], least: int = LEAST) -> Iterator[np.ndarray]:
    """The runs of each text, word numbers from 0."""
    numbers, starts = numbered(texts)
    rows = runs(numbers, least)
    edge = np.searchsorted(rows[:, 0], np.append(starts, len(numbers)))
    for k, start in enumerate(starts):
        yield rows[edge[k] : edge[k + 1]] - [start, 0, 0]


def kept_words(words: list[bytes], rows: np.ndarray) -> list[bytes]:
    """Of each run the first period; what any run repeats goes."""
    if not len(rows):
        return words
    depth = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(depth, rows[:, 0] + rows[:, 2], 1)
    np.add.at(depth, rows[:, 0] + rows[:, 1], -1)
    return [words[k] for k in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]


def periodic_runs(df: DataFrame, text_col: str = "text", least: int = LEAST, keep: list[str] | None = None) -> DataFrame:
    """`df` (or its columns `keep`) with `runs` and `collapsed`, which replace columns of the same names.

    runs: array of (start, length, period), by start and period, in words [^\\x20\\x09-\\x0D]+ numbered from 0, of every
    run with at least `least` (12 or more) and two periods of words. collapsed: the words that are in no run behind its
    first period, joined by one space. Null, empty and blank texts have no runs and collapse to an empty text. Rows are
    independent of each other, so repeated rows, ties and empty tables need no rule; a text is looked at as a whole.
    """
    if least < LEAST:
        raise ValueError(f"runs have at least {LEAST} words")

    def groups(texts: list[str | None]) -> Iterator[list[list[bytes]]]:
        group, size = [], 0
        for text in texts:
            words = encoded(text).split()
            if group and size + len(words) > TOGETHER:
                yield group
                group, size = [], 0
            group.append(words)
            size += len(words)
        if group:
            yield group

    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for group in groups(batch["text"].to_pylist()):
                found = list(of_texts(group, least))
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
                flat = np.concatenate(found)
                values = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(kind.value_type))
                short = [b" ".join(kept_words(*x)).decode("utf-8", "replace") for x in zip(group, found, strict=True)]
                columns = [batch["row"].slice(done, len(group)), pa.ListArray.from_arrays(offsets, values, type=kind), pa.array(short, pa.string())]
                done += len(group)
                yield pa.RecordBatch.from_arrays(columns, names=["row", "runs", "collapsed"])

    rows = narrowed(packed(df, text=F.col(text_col)), keep)
    schema = row_and(rows, "runs array<struct<start: long, length: long, period: long>>, collapsed string")
    return unpacked(rows.mapInArrow(run, schema), "runs", "collapsed")
