"""Byte-level BPE encoding and decoding with tiktoken and a local rank file."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profspark.llm.scratch import narrowed, packed, row_and, unpacked

#: Texts are encoded in parts of about so many characters.
PART = 1 << 16
#: Between a letter or digit and a space or line break no match of the pattern goes on: matches hold white space only
#: as their first character or as a whole.
SAFE = re.compile(r"[A-Za-z0-9](?=[ \n])")
#: White space as the pattern's \\s has it. Long runs are more than the regular expression engine can step back over;
#: they go to the merge step directly: all but the last character are one match, or all of them at the text's end.
RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4096,}")


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def matched_runs(text: str) -> Iterator[tuple[str, bool]]:
    """The text in order; with True, what is one match of the pattern for sure."""
    at = 0
    for run in RUN.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        yield text[at : run.start()], False
        yield text[run.start() : end], True
        at = end
    yield text[at:], False


def parts(text: str, size: int = PART) -> Iterator[str]:
    """The text, cut at safe boundaries only; a part is longer where there is none."""
    at = 0
    while len(text) - at > size:
        cut = SAFE.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.end()]
        at = cut.end()
    yield text[at:]


def ids(text: str, path: str, pattern: str) -> np.ndarray:
    enc = encoding(path, pattern)
    if len(text) <= 4096:
        return enc.encode_to_numpy(text, disallowed_special=()).astype("<u4")
    out = []
    for piece, is_match in matched_runs(text):
        if is_match:
            out.append(np.array(enc._encode_single_piece(piece), dtype="<u4"))
        else:
            out += [enc.encode_to_numpy(p, disallowed_special=()) for p in parts(piece)]
    return np.concatenate(out).astype("<u4")


def encoded(df: DataFrame, path: str, pattern: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`df` (or its columns `keep`) with n_tokens and ids, which replace columns of the same names.

    ids: binary, little-endian unsigned 32-bit integers. Special tokens are not known: their strings are ordinary text.
    Null texts count as empty and have no ids. Long texts are cut at safe boundaries, which changes no id. `path` names
    the rank file on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [ids(t or "", path, pattern) for t in part["text"].to_pylist()]
                columns = [pa.array([len(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())]
                yield pa.RecordBatch.from_arrays([part["row"], *columns], names=["row", "n_tokens", "ids"])

    rows = narrowed(packed(df, text=F.col(text_col)), keep)
    return unpacked(rows.mapInArrow(run, row_and(rows, "n_tokens long, ids binary")), "n_tokens", "ids")


def decoded(df: DataFrame, path: str, pattern: str, ids_col: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """`df` (or its columns `keep`) with `bytes`, which the ids stand for; null ids give no bytes. They need not be UTF-8."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                data = [enc.decode_bytes(np.frombuffer(x or b"", dtype="<u4").tolist()) for x in part["ids"].to_pylist()]
                yield pa.RecordBatch.from_arrays([part["row"], pa.array(data, pa.binary())], names=["row", "bytes"])

    rows = narrowed(packed(df, ids=F.col(ids_col)), keep)
    return unpacked(rows.mapInArrow(run, row_and(rows, "bytes binary")), "bytes")
