"""Toxicity with a counterfactual-regularised classifier.

A sparse logistic regression over the words of a text and their beginnings. In labelled texts that name a group of people, the group's terms
are swapped for other terms of the same kind, or for an unknown word; training adds a penalty on the squared change of the
score's logit. A term that is frequent in toxic texts so cannot become evidence by itself, and neutral mentions of a
group keep a low score.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profspark.llm.sampling import first_rows
from profspark.llm.scratch import Scratch, narrowed, packed, row_and, unpacked
from profspark.llm.words import ALNUM, U64, encoded, mix, words

# Terms that name groups, by kind.
IDENTITIES = {
    "en_plural": "people women men muslims christians jews immigrants blacks whites asians arabs gays lesbians",
    "en_person": "person woman man muslim christian jew immigrant",
    "en_adjective": "human female male muslim christian jewish black white asian arab gay lesbian transgender disabled",
    "de_plural": "menschen frauen männer muslime christen juden ausländer flüchtlinge",
    "de_person": "mensch frau mann muslim christ jude ausländer flüchtling",
    "fr_plural": "personnes femmes hommes musulmans chrétiens juifs immigrés arabes",
    "fr_person": "personne femme homme musulman chrétien juif immigré arabe",
    "es_plural": "personas mujeres hombres musulmanes cristianos judíos inmigrantes árabes",
    "es_person": "persona mujer hombre musulmán cristiano judío inmigrante árabe",
}
#: The model is fitted on at most so many labelled rows of each label, the first in the order of a hash of their ids.
ROWS_PER_LABEL = 5000
#: It has at most so many features: those in LEAST rows or more whose presence differs most between the labels.
VOCABULARY = 20_000
LEAST = 5
SWAPS = 4
BEGINNINGS = [4, 5, 6, 7, 8]


def text_words(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a text's distinct words, in lower case, and their features: the word and its first 4 to 8 bytes.

    Beginnings catch inflected forms of a stem. A row has zeros for beginnings longer than the word.
    """
    data = encoded((text or "").lower())
    h, start, end = words(data, ALNUM)
    h, first = np.unique(h, return_index=True)
    start, size = start[first], end[first] - start[first]
    raw = np.frombuffer(data + bytes(BEGINNINGS[-1]), dtype=np.uint8)
    out = np.zeros((len(h), 1 + len(BEGINNINGS)), dtype=U64)
    out[:, 0] = h
    code = np.zeros(len(h), dtype=U64)
    for i in range(BEGINNINGS[-1]):
        code |= raw[start + i].astype(U64) << U64(8 * i)
        if i + 1 in BEGINNINGS:
            at = 1 + BEGINNINGS.index(i + 1)
            out[:, at] = np.where(size > i, mix(code + U64((i + 1) << 56)), U64(0))
    return h, out


def features(rows: np.ndarray) -> np.ndarray:
    return np.unique(rows[rows != 0])


@cache
def _kinds() -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind the hashes and the features of its terms, in order."""
    found = [[text_words(term) for term in terms.split()] for terms in IDENTITIES.values()]
    return [(np.concatenate([h for h, _ in kind]), np.concatenate([f for _, f in kind])) for kind in found]


def swapped(h: np.ndarray, rows: np.ndarray, swaps: int = SWAPS) -> list[np.ndarray]:
    """Features of copies with each group term replaced by another of its kind, in the first copy by a word without any.

    Terms that may all be swapped for each other could still count as evidence together; the unknown word rules that out.
    """
    named = [(k, int(i)) for k, (terms, _) in enumerate(_kinds()) for i in np.flatnonzero(np.isin(terms, h))]
    if not named:
        return []
    rest = rows[~np.isin(h, np.concatenate([terms for terms, _ in _kinds()]))]
    out = []
    for s in range(swaps):
        new = [_kinds()[k][1][(i + s) % len(_kinds()[k][0])] for k, i in named] if s else []
        out.append(features(np.vstack((rest, *new))))
    return out


class Model:
    """Sorted features, their weights, and an intercept."""

    def __init__(self, vocabulary: np.ndarray, weight: np.ndarray, intercept: float):
        self.vocabulary, self.weight, self.intercept = vocabulary, weight, intercept

    def score(self, own: np.ndarray) -> float:
        logit = self.intercept
        if len(own) and len(self.vocabulary):
            at = np.minimum(np.searchsorted(self.vocabulary, own), len(self.vocabulary) - 1)
            logit += float(self.weight[at[self.vocabulary[at] == own]].sum())
        return float(1 / (1 + np.exp(-min(max(logit, -500), 500))))


class _Rows:
    """Word sets as indexes into the vocabulary, one after the other."""

    def __init__(self, sets: list[np.ndarray], size: int):
        self.index = np.concatenate(sets) if sets else np.empty(0, np.int64)
        self.row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        self.count, self.size = len(sets), size

    def times(self, weight: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weight[self.index], self.count)

    def gathered(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.index, values[self.row], self.size)


def fit(vocabulary: np.ndarray, sets: list[np.ndarray], label: np.ndarray, weight: np.ndarray, pairs: list[tuple[int, np.ndarray]], counterfactual: float = 1.0, sparsity: float = 2e-4, rounds: int = 400) -> Model:
    """Accelerated proximal gradient steps on weighted log loss + counterfactual * mean squared logit change + L1.

    sets: each row's indexes into the vocabulary; pairs: a row's number and a swapped copy's indexes.
    """
    size = len(vocabulary)
    x, swap = _Rows(sets, size), _Rows([p[1] for p in pairs], size)
    origin = np.array([p[0] for p in pairs], dtype=np.int64)
    share = weight / weight.sum()
    w, b = np.zeros(size), float(np.log(max(share @ label, 1e-9) / max(1 - share @ label, 1e-9)))
    look_w, look_b, t = w, b, 1.0
    # A bound on the curvature: of the log loss a quarter of the squared length of rows, by power iteration.
    v = np.ones(size) / max(1, size) ** 0.5
    scale = 1.0
    for _ in range(15):
        u = x.gathered(share * x.times(v)) / 4
        if pairs:
            d = x.times(v)[origin] - swap.times(v)
            back = np.bincount(origin, d, x.count)
            u += 2 * counterfactual * (x.gathered(back) - swap.gathered(d)) / len(pairs)
        scale = float(np.linalg.norm(u)) or 1.0
        v = u / scale
    step = 0.5 / (scale + 0.25)
    for _ in range(rounds):
        logit = x.times(look_w) + look_b
        miss = share * (1 / (1 + np.exp(-np.clip(logit, -500, 500))) - label)
        grad = x.gathered(miss)
        if pairs:
            d = (logit - look_b)[origin] - swap.times(look_w)
            grad += 2 * counterfactual * (x.gathered(np.bincount(origin, d, x.count)) - swap.gathered(d)) / len(pairs)
        new_w, new_b = look_w - step * grad, look_b - step * miss.sum()
        new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - step * sparsity, 0)
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        look_w, look_b = new_w + (t - 1) / t_new * (new_w - w), new_b + (t - 1) / t_new * (new_b - b)
        w, b, t = new_w, new_b, t_new
    used = w != 0
    return Model(vocabulary[used], w[used], b)


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows_per_label: int = ROWS_PER_LABEL, counterfactual: float = 1.0) -> Model:
    """Fits a model on at most `rows_per_label` rows of `labels` with label 1 and as many with 0, and their texts in `df`.

    Rows are weighted back to the labels' true shares. Null ids and labels other than 0 and 1 are passed over. Without
    any labelled text the score is one half throughout.
    """
    spark = df.sparkSession
    named = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    totals = {r.label: r["count"] for r in named.groupBy("label").count().collect()}
    one, zero = (first_rows(named.where(F.col("label") == v), "id", rows_per_label, totals.get(v, 0)) for v in (1, 0))
    chosen = one.unionByName(zero)
    # Bounded by the two limits, so that it may be sent to all executors.
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").select("label", "text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                own = [features(text_words(t)[1]).view(np.int64) for t in part["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([part["label"], pa.array(own, pa.list_(pa.int64()))], names=["label", "features"])

    scratch = Scratch(spark)
    sample = scratch.keep(texts)
    n = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    ones, zeros = n.get(1, 0), n.get(0, 0)
    found = sample.mapInArrow(read, "label int, features array<long>")
    counts = found.select("label", F.explode("features").alias("word")).groupBy("word").agg(F.sum("label").alias("a"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST)
    differ = F.abs(F.col("a") / max(1, ones) - (F.col("n") - F.col("a")) / max(1, zeros)) / F.sqrt(F.col("n"))
    vocabulary = np.unique(counts.orderBy(F.desc(differ), "word").limit(VOCABULARY).select("word").toArrow()["word"].to_numpy().view(U64))
    if not len(vocabulary) or not ones or not zeros:
        rate = 0.5 if not ones and not zeros else min(max(ones / (ones + zeros), 1e-3), 1 - 1e-3)
        return Model(np.empty(0, U64), np.empty(0), float(np.log(rate / (1 - rate))))
    vocabulary = np.union1d(vocabulary, features(np.concatenate([f for _, f in _kinds()])))
    known = spark.sparkContext.broadcast(vocabulary)

    def index(own: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(known.value, own), len(known.value) - 1)
        return at[known.value[at] == own].astype(np.int32)

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for label, text in zip(batch["label"].to_pylist(), batch["text"].to_pylist(), strict=True):
                h, rows = text_words(text)
                sets = [index(features(rows)), *map(index, swapped(h, rows))]
                yield pa.RecordBatch.from_arrays([pa.array([label], pa.int32()), pa.array([sets], pa.list_(pa.list_(pa.int32())))], names=["label", "sets"])

    # At most VOCABULARY small integers for each of a bounded number of rows.
    sets, label, pairs = [], [], []
    for row in sample.mapInArrow(narrow, "label int, sets array<array<int>>").toArrow().to_batches():
        for y, s in zip(row["label"].to_pylist(), row["sets"], strict=True):
            own = [v.values.to_numpy().astype(np.int64) for v in s]
            pairs += [(len(sets), c) for c in own[1:]]
            sets.append(own[0])
            label.append(y)
    scratch.drop(sample)
    label = np.array(label, dtype=float)
    weight = np.where(label == 1, totals[1] / ones, totals[0] / zeros)
    return fit(vocabulary, sets, label, weight, pairs, counterfactual)


def scored(df: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`df` (or its columns `keep`) with `score`, from 0 to 1, which replaces a column of that name.

    All words of the whole text count. Null and empty texts get the score of a text of unknown words.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = [shared.value.score(features(text_words(t)[1])) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(score, pa.float64())], names=["row", "score"])

    rows = narrowed(packed(df, text=F.col(text_col)), keep)
    return unpacked(rows.mapInArrow(run, row_and(rows, "score double")), "score")
