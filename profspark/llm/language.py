"""Language identification of code-switched text: a linear-chain conditional random field over words.

A word's label score is the sum of learned weights of its features: the word itself (lexicon), its first and last one
to four bytes (affixes) and its byte trigrams. Learned transition scores link the labels of neighbouring words.
Training maximises the likelihood of label sequences of short passages, most of them put together from documents of
different languages; labelling computes each word's label probabilities by forward-backward.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from profspark.llm.sampling import SCALE, bound
from profspark.llm.scratch import narrowed, packed, row_and, unpacked
from profspark.llm.words import LETTERS, PIECE, U64, _powers, encoded, mix, words

BUCKETS = 1 << 18
#: The model is fitted on at most so many different texts of each language, the first in the order of their hashes.
DOCS_PER_LANGUAGE = 400
#: Passages are so many words long, and so many are drawn from a document, spread over all of it. A document of fewer
#: words gives one, in which its words are repeated.
PASSAGE, PASSAGES = 12, 10
BLOCK = 64
AFFIXES = 4
UNDETERMINED = "und"


def features(data: bytes) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of words: their number, buckets of one feature per word and row, trigram buckets, and trigrams per word.

    Data is in lower case. Runs end between words, so that a long text is never held as a whole with all its features.
    """
    power, inverse = _powers()
    h, start, end = words(data, LETTERS)
    raw = np.frombuffer(data, dtype=np.uint8)
    at = 0
    while at < len(h):
        stop = max(at + 1, int(np.searchsorted(end, start[at] + PIECE - 8, "right")))
        first, last = int(start[at]), int(end[stop - 1])
        s, e = start[at:stop] - first, end[at:stop] - first
        own = h[at:stop]
        at = stop
        if last - first > PIECE - 8:  # one word longer than a piece: its spelling is nothing to learn from
            yield 1, (own % U64(BUCKETS)).astype(np.int64)[None, :], np.empty(0, np.int64), np.zeros(1, np.int64)
            continue
        value = LETTERS.value[raw[first:last]]
        total = np.zeros(last - first + 1, dtype=U64)
        np.cumsum(value * power[: len(value)], out=total[1:])
        rows = [own]
        for n in range(1, AFFIXES + 1):
            a, b = np.minimum(s + n, e), np.maximum(e - n, s)
            rows.append(mix((total[a] - total[s]) * inverse[s] + U64(2 * n)))
            rows.append(mix((total[e] - total[b]) * inverse[b] + U64(2 * n + 1)))
        tri = (total[3:] - total[:-3]) * inverse[: len(value) - 2] if len(value) > 2 else total[:0]
        count = np.maximum(e - s - 2, 0)
        inside = np.repeat(s - np.cumsum(count) + count, count) + np.arange(count.sum())
        yield len(s), (np.stack(rows) % U64(BUCKETS)).astype(np.int64), (mix(tri[inside] + U64(99)) % U64(BUCKETS)).astype(np.int64), count


def _per_word(values: np.ndarray, count: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros((1, values.shape[1]), values.dtype), np.cumsum(values, axis=0)))
    end = np.cumsum(count)
    return total[end] - total[end - count]


class Crf:
    def __init__(self, labels: list[str]):
        k = len(labels)
        self.labels = labels
        self.weight = np.zeros((BUCKETS, k), dtype=np.float32)
        self.move = np.zeros((k, k))

    def scores(self, rows: np.ndarray, tri: np.ndarray, count: np.ndarray) -> np.ndarray:
        out = self.weight[rows[0]].astype(np.float64)
        for r in rows[1:]:
            out += self.weight[r]
        # Trigrams count by their mean, so that long words do not outweigh their neighbours.
        return out + _per_word(self.weight[tri].astype(np.float64), count) / np.maximum(count, 1)[:, None]

    def fit(self, passages: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], rounds: int = 4, batch: int = 128, rate: float = 0.3, decay: float = 1e-4) -> None:
        """passages: feature rows, trigrams, trigrams per word, labels; all of one length. Adagrad on the likelihood."""
        k, rng = len(self.labels), np.random.default_rng(7)
        square, move_square = np.full((BUCKETS, k), 1e-3, dtype=np.float32), np.full((k, k), 1e-3)
        for _ in range(rounds):
            order = rng.permutation(len(passages))
            for at in range(0, len(order), batch):
                part = [passages[i] for i in order[at : at + batch]]
                rows, tri, count = np.concatenate([x[0] for x in part], axis=1), np.concatenate([x[1] for x in part]), np.concatenate([x[2] for x in part])
                truth = np.stack([x[3] for x in part])
                b, t = truth.shape
                prob, pairs = self.marginals(self.scores(rows, tri, count).reshape(b, t, k))
                prob[np.arange(b)[:, None], np.arange(t)[None, :], truth] -= 1
                np.subtract.at(pairs, (truth[:, :-1].ravel(), truth[:, 1:].ravel()), 1)
                grad = (prob / b).reshape(b * t, k)
                where = np.concatenate([*rows, tri])
                what = np.concatenate([np.tile(grad, (len(rows), 1)), np.repeat(grad / np.maximum(count, 1)[:, None], count, axis=0)])
                used, inverse = np.unique(where, return_inverse=True)
                g = np.stack([np.bincount(inverse, what[:, c], len(used)) for c in range(k)], axis=1) + decay * self.weight[used]
                square[used] += g * g
                self.weight[used] -= rate * g / np.sqrt(square[used])
                pairs = pairs / b + decay * self.move
                move_square += pairs * pairs
                self.move -= rate * pairs / np.sqrt(move_square)

    def marginals(self, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Label probabilities (sequence, word, label), and expected counts of label pairs over all sequences."""
        b, t, k = score.shape
        x, move = np.exp(score - score.max(axis=2, keepdims=True)), np.exp(self.move)
        alpha, beta = np.empty_like(x), np.ones_like(x)
        alpha[:, 0] = x[:, 0] / x[:, 0].sum(axis=1, keepdims=True)
        for i in range(1, t):
            a = alpha[:, i - 1] @ move * x[:, i]
            alpha[:, i] = a / a.sum(axis=1, keepdims=True)
        pairs = np.zeros((k, k))
        for i in range(t - 2, -1, -1):
            after = x[:, i + 1] * beta[:, i + 1]
            both = alpha[:, i, :, None] * move[None] * after[:, None, :]
            pairs += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            back = after @ move.T
            beta[:, i] = back / back.sum(axis=1, keepdims=True)
        prob = alpha * beta
        return prob / prob.sum(axis=2, keepdims=True), pairs

    def label(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Label probabilities of all words of several texts, whose scores follow each other.

        Texts are cut into blocks of words. A block's transfer matrix is a product of its words' matrices, all blocks at
        once; messages then pass from block to block, and at last inside all blocks at once. That is forward-backward
        over whole texts, without a step per word of the longest one.
        """
        k = len(self.labels)
        x = np.exp(scores - scores.max(axis=1, keepdims=True))
        move = np.exp(self.move)
        blocks = -(-lengths // BLOCK)
        text = np.repeat(np.arange(len(lengths)), blocks)
        first_block = np.cumsum(blocks) - blocks
        number = np.arange(blocks.sum()) - first_block[text]
        begin = (np.cumsum(lengths) - lengths)[text] + number * BLOCK
        size = np.minimum(BLOCK, lengths[text] - number * BLOCK)
        nb = len(text)
        padded = np.ones((BLOCK, nb, k))
        at = np.arange(BLOCK)[:, None] + begin[None, :]
        real = np.arange(BLOCK)[:, None] < size[None, :]
        padded[real] = x[at[real]]
        matrix = np.broadcast_to(np.eye(k), (nb, k, k)).copy()
        for i in range(BLOCK):
            step = (matrix.reshape(-1, k) @ move).reshape(nb, k, k) * padded[i][:, None, :]
            step /= step.sum(axis=(1, 2), keepdims=True)
            matrix = np.where(real[i][:, None, None], step, matrix)
        # A text's first word has no transition: its incoming message, once moved, is flat for every label.
        into, out = np.empty((nb, k)), np.empty((nb, k))
        flat = np.linalg.solve(move.T, np.ones(k))
        into[number == 0], out[number == blocks[text] - 1] = flat, 1
        for j in range(1, int(blocks.max(initial=0))):
            own = np.flatnonzero(number == j)
            into[own] = np.einsum("bi,bij->bj", into[own - 1], matrix[own - 1])
            into[own] /= np.abs(into[own]).sum(axis=1, keepdims=True)
        left = blocks[text] - number
        for j in range(2, int(blocks.max(initial=0)) + 1):
            own = np.flatnonzero(left == j)
            out[own] = np.einsum("bij,bj->bi", matrix[own + 1], out[own + 1])
            out[own] /= out[own].sum(axis=1, keepdims=True)
        alpha = np.empty((BLOCK, nb, k))
        message = into
        for i in range(BLOCK):
            step = message @ move * padded[i]
            step /= step.sum(axis=1, keepdims=True)
            message = np.where(real[i][:, None], step, message)
            alpha[i] = message
        beta = out
        for i in range(BLOCK - 1, -1, -1):
            alpha[i] *= beta
            back = (padded[i] * beta) @ move.T
            back /= back.sum(axis=1, keepdims=True)
            beta = np.where(real[i][:, None], back, beta)
        prob = np.empty((len(scores), k))
        prob[at[real]] = alpha[real]
        return prob / prob.sum(axis=1, keepdims=True)


def _cut(text: str) -> list[bytes]:
    """Passages spread over the whole text, in lower case; each is shorter than a piece."""
    data, out, every = encoded(text.lower()), [], 1
    _, starts, ends = words(data, LETTERS)
    at = 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + PIECE - 8, "right")))
        if ends[at] - starts[at] <= PIECE - 8:
            s, e = starts[at:stop], ends[at:stop]
            if len(s) >= PASSAGE:
                places = np.unique(np.linspace(0, len(s) - PASSAGE, PASSAGES).astype(int))
                out += [data[s[k] : e[k + PASSAGE - 1]] for k in places.tolist()][::every]
            elif len(starts) < PASSAGE and at == 0:
                own = [data[x:y] for x, y in zip(s.tolist(), e.tolist(), strict=True)]
                out.append(b" ".join((own * PASSAGE)[:PASSAGE]))
        at = stop
        if len(out) > 4 * PASSAGES:
            out, every = out[::2], 2 * every
    return out


def _passage(data: bytes, label: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    parts = list(features(data))
    rows, tri, count = (np.concatenate([p[i] for p in parts], axis=-1) for i in (1, 2, 3))
    return rows, tri, count, np.full(rows.shape[1], label)


def _joined(pieces: list, rng: np.random.Generator) -> list:
    """Each passage beside two others, drawn at random and so mostly of other languages."""
    others = [pieces[i] for i in rng.integers(0, len(pieces), 2 * len(pieces))]
    return [tuple(np.concatenate(x, axis=-1) for x in zip(a, b, c, strict=True)) for a, b, c in zip(pieces, others[::2], others[1::2], strict=True)]


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang", docs_per_language: int = DOCS_PER_LANGUAGE) -> Crf:
    """Fits a model of every language on at most `docs_per_language` different texts of each.

    Rows without text or language are passed over. Each document's words all count as words of its language. Executors
    cut the passages to learn from; the driver gets nothing else of the texts, about 6 MB for each language at most, and
    the model has 2 MB of weights for each.
    """
    rows = df.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    rows = rows.withColumn("hash", F.xxhash64("text"))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct("hash").alias("texts")).orderBy(F.desc("rows"), "lang").collect()
    langs = [r.lang for r in counts]
    model = Crf(langs)
    if not langs:
        return model
    # A language's few texts with low hashes are all that is moved, each once.
    low = F.create_map(*[F.lit(x) for r in counts for x in (r.lang, bound(docs_per_language, r.texts))])
    some = rows.where(F.pmod("hash", F.lit(SCALE)) < F.element_at(low, F.col("lang")))
    some = some.groupBy("lang", "hash").agg(F.min("text").alias("text"))
    order = Window.partitionBy("lang").orderBy(F.pmod("hash", F.lit(SCALE)), "hash")
    some = some.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= docs_per_language)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(lang, rank, at, passage) for lang, rank, text in zip(*(batch[c].to_pylist() for c in ("lang", "rank", "text")), strict=True) for at, passage in enumerate(_cut(text))]
            columns = list(zip(*found, strict=True)) if found else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["lang", "rank", "at", "passage"])

    passages = some.mapInArrow(cut, "lang string, rank int, at int, passage binary").sort("lang", "rank", "at")
    number = {lang: k for k, lang in enumerate(langs)}
    pieces = [_passage(bytes(r.passage), number[r.lang]) for r in passages.toLocalIterator()]
    if pieces:
        model.fit(_joined(pieces, np.random.default_rng(11)))
    return model


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def identified(df: DataFrame, model: Crf, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`df` (or its columns `keep`) with lang_pred, score and langs, which replace columns of the same names.

    langs: for each language its share of the text's words, by their label probabilities. lang_pred has the largest
    share (of equal ones the first learned), which is the score. A text that is null or has no letter, and every text
    where nothing was learned, is `und` with score 0. Every word of a text counts, however long it is.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    langs_type = pa.map_(pa.string(), pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = shared.value
        for batch in batches:
            at = 0
            texts = [t if t and has_letter(t) else "" for t in batch["text"].to_pylist()]
            while at < len(texts):
                stop, size = at, 0
                while stop < len(texts) and (size < 1 << 19 or stop == at):
                    size += len(texts[stop])
                    stop += 1
                scores, lengths = [], []
                for t in texts[at:stop]:
                    own = [crf.scores(*x[1:]) for x in features(encoded(t.lower()))] if crf.labels else []
                    scores += own
                    lengths.append(sum(map(len, own)))
                lengths = np.array(lengths, dtype=np.int64)
                shares: list[np.ndarray | None] = [None] * len(lengths)
                if lengths.sum():
                    full = np.flatnonzero(lengths)
                    prob = crf.label(np.concatenate(scores), lengths[full])
                    sums = np.add.reduceat(prob, np.cumsum(lengths[full]) - lengths[full], axis=0) / lengths[full, None]
                    for i, s in zip(full.tolist(), sums, strict=True):
                        shares[i] = s
                best = [(UNDETERMINED, 0.0, []) if s is None else (crf.labels[int(s.argmax())], min(1.0, float(s.max())), list(zip(crf.labels, s.tolist(), strict=True))) for s in shares]
                columns = zip(*best, strict=True)
                yield pa.RecordBatch.from_arrays([batch["row"].slice(at, stop - at), *map(pa.array, columns, (pa.string(), pa.float64(), langs_type))], names=["row", "lang_pred", "score", "langs"])
                at = stop

    rows = narrowed(packed(df, text=F.col(text_col)), keep)
    return unpacked(rows.mapInArrow(run, row_and(rows, "lang_pred string, score double, langs map<string, double>")), "lang_pred", "score", "langs")


def fold(id_col: str, parts: int) -> Column:
    """The remainder of a row's checksum, which deals rows into learning and held-out ones."""
    return F.crc32(F.col(id_col).cast("string")) % parts
