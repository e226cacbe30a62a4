"""Benchmark decontamination: a broadcast hash set of the test items' n-grams, and one scan over the training texts.

Items are cut into overlapping chunks, and chunks dealt into blocks of about BLOCK_WORDS words. A block's windows make
one hash set, which is small enough to be broadcast whatever the size of the benchmark; documents are scanned once for
each block. Every hit is verified word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from profspark.llm.scratch import Scratch, narrowed, packed, row_and, unpacked
from profspark.llm.words import ALNUM, U64, encoded, windows, words

SIZE = 10
#: A block holds about so many words: some 50 MB on the driver and in each Python worker.
BLOCK_WORDS = 1 << 20
CHUNK_WORDS = 1 << 12
FOUND = "n_words long, n_hit long, spans array<struct<first: long, last: long, start: long, end: long>>, items array<string>"


def normal(data: bytes) -> list[bytes]:
    return data.translate(ALNUM.table).split()


class Grams:
    """The windows of one block: sorted hashes by window length, and where each stands in the chunks' texts."""

    def __init__(self, chunks: list[tuple[str | None, bytes]], size: int):
        self.items = [item for item, _ in chunks]
        self.texts = [text for _, text in chunks]
        rows: dict[int, list[np.ndarray]] = {}
        for at, text in enumerate(self.texts):
            h, start, end = words(text, ALNUM)
            n = min(size, len(h))
            if n:
                count = len(h) - n + 1
                where = np.stack([np.full(count, at), start[:count], end[n - 1 :]]).astype(np.int64)
                rows.setdefault(n, []).append(np.vstack([windows(h, n).view(np.int64), where]))
        self.by_length = {}
        for n, parts in rows.items():
            together = np.concatenate(parts, axis=1)
            hashes = together[0].view(U64)
            order = np.argsort(hashes, kind="stable")
            bits = 1 << max(12, int(len(order) * 16).bit_length())
            seen = np.zeros(bits, dtype=bool)
            seen[(hashes & U64(bits - 1)).astype(np.int64)] = True
            self.by_length[n] = (hashes[order], together[1:, order], seen)

    def hits(self, data: bytes, h: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, set]:
        """For each word, whether a window covers it; and the chunks of the windows that occur."""
        cover = np.zeros(len(h) + 1, dtype=np.int64)
        items = set()
        for n, (hashes, where, seen) in self.by_length.items():
            w = windows(h, n)
            maybe = np.flatnonzero(seen[(w & U64(len(seen) - 1)).astype(np.int64)])
            left, right = (np.searchsorted(hashes, w[maybe], side) for side in ("left", "right"))
            for i, a, b in zip(maybe.tolist(), left.tolist(), right.tolist(), strict=True):
                if a < b:
                    text = b" ".join(normal(data[start[i] : end[i + n - 1]]))
                    same = [k for k in range(a, b) if self.texts[where[0, k]][where[1, k] : where[2, k]] == text]
                    if same:
                        cover[i] += 1
                        cover[i + n] -= 1
                        items.update(self.items[where[0, k]] for k in same)
        return np.cumsum(cover[:-1]) > 0, items


def _chunks(items: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(item, part, text, n) with normal words parted by spaces; consecutive chunks share size - 1 words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch["item"].to_pylist(), batch["text"].to_pylist(), strict=True):
                w = normal(encoded(text))
                starts = range(0, max(1, len(w) - size + 1), CHUNK_WORDS)
                for part, at in enumerate(starts if w else ()):
                    own = w[at : at + CHUNK_WORDS + size - 1]
                    yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in ((item, pa.string()), (part, pa.int64()), (b" ".join(own), pa.binary()), (len(own), pa.int64()))], names=["item", "part", "text", "n"])

    rows = items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")).distinct()
    return rows.mapInArrow(cut, "item string, part long, text binary, n long")


def contamination(
    df: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = SIZE, keep: list[str] | None = None
) -> DataFrame:
    """`df` (or its columns `keep`) with n_words, n_hit, spans and items, which replace columns of the same names.

    Words: A-Z in lower case, runs of ASCII letters, digits and characters beyond ASCII. A window is `size` words in a
    row of an item; an item of fewer words, but not none, is one window. Hit words are those inside an occurrence of a
    window. spans: runs of hit words, with their first and last word's number and their first and last byte (the latter
    exclusive). items: ids of the items with occurring windows, as strings, sorted, each once; an item without id hits
    but is not listed. Null and empty texts have no words, on either side. Repeated rows, here or there, change nothing
    for others. No items, or none with words, hit nothing. Order and ties play no part.
    """
    scratch = Scratch(df.sparkSession)
    chunks = scratch.keep(_chunks(items, item_id, item_text, size))
    blocks = -(-(chunks.agg(F.sum("n")).first()[0] or 0) // BLOCK_WORDS) or 1
    rows = narrowed(packed(df, text=F.col(text_col)), keep)
    rows = rows.withColumns({"spans": F.lit(None).cast("array<struct<first: long, last: long, start: long, end: long>>"), "items": F.lit(None).cast("array<string>")})
    for block in range(blocks):
        own = chunks.where(F.pmod(F.xxhash64("item", "part"), F.lit(blocks)) == block).select("item", "text").toArrow()
        grams = df.sparkSession.sparkContext.broadcast(Grams(list(zip(own["item"].to_pylist(), own["text"].to_pylist(), strict=True)), size))
        last = block == blocks - 1
        rows = _scan(rows, grams, row_and(rows, FOUND if last else f"text string, {FOUND}"), last)
        rows = rows if last else scratch.keep(rows)
    return unpacked(rows, "n_words", "n_hit", "spans", "items")


def _scan(rows: DataFrame, grams, schema: T.StructType, last: bool) -> DataFrame:
    spans_type = pa.list_(pa.struct([(c, pa.int64()) for c in ("first", "last", "start", "end")]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_hit, spans, items = [], [], [], []
            for i, text in enumerate(batch["text"].cast(pa.binary())):
                data = text.as_py() or b""
                h, start, end = words(data, ALNUM)
                hit, found = grams.value.hits(data, h, start, end)
                for s in batch["spans"][i].as_py() or ():
                    hit[s["first"] : s["last"] + 1] = True
                found.update(batch["items"][i].as_py() or ())
                edge = np.diff(np.concatenate(([False], hit, [False])).astype(np.int8))
                first, after = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
                n_words.append(len(h))
                n_hit.append(int(hit.sum()))
                spans.append([{"first": a, "last": b, "start": int(start[a]), "end": int(end[b])} for a, b in zip(first.tolist(), after.tolist(), strict=True)])
                items.append(sorted(x for x in found if x is not None))
            found = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(spans, spans_type), pa.array(items, pa.list_(pa.string()))]
            kept = ["row"] if last else ["row", "text"]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in kept], *found], names=[*kept, "n_words", "n_hit", "spans", "items"])

    return rows.mapInArrow(scan, schema)


def decontaminated(df: DataFrame, items: DataFrame, text_col: str = "text", drop_share: float = 0.5, **options) -> DataFrame:
    """`df` without the hit spans; documents of which more than `drop_share` of the words are hit go altogether.

    With drop_share=0 every document with a hit goes. Texts without a hit, null ones among them, stay as they are.
    """
    found = contamination(packed(df, text=F.col(text_col)), items, **options)
    data = F.encode("text", "utf-8")
    ends = F.concat(F.array(F.lit(0).cast("long")), F.col("spans.end"))
    starts = F.concat(F.col("spans.start"), F.array(F.octet_length("text").cast("long")))
    parts = F.transform(F.arrays_zip(ends.alias("a"), starts.alias("b")), lambda s: F.decode(F.substring(data, (s["a"] + 1).cast("int"), (s["b"] - s["a"]).cast("int")), "utf-8"))
    kept = found.where(F.col("n_hit") <= F.col("n_words") * F.lit(drop_share))
    cut = F.when(F.col("n_hit") > 0, F.array_join(parts, "")).otherwise(F.col("text"))
    fields = df.columns
    return kept.select(*[cut.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in fields])
