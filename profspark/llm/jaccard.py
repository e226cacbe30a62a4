"""N-gram Jaccard join: size-banded tiles, bitmap bounds, exact intersection of sorted arrays.

Sets of word shingles (as 64-bit hashes) are put into size bands. Two sets of a band that reach the similarity differ
in a bounded number of shingles, D. The band's hash space is cut into more than D segments, so that at least one segment
has no difference. A *tile* is all sets of a band that agree in one segment; both sides of every link meet in a tile,
whatever the data. Tiles of one set, by far the most, end there.

Signatures that only one set has, by far the most, are found before rows of them are made: tasks deal their signatures,
each at most twice, to ranges as plain arrays, and a range keeps those it gets twice. Rows (signature, set) are made of
what a bounded filter of the kept ones lets pass; a join settles the rest.

Inside tiles no list of all pairs is made:

1. Each set is compared with the leader of its tiles (the set with the most company over its segments), which is linear
   and joins the bulk of any group of copies. Bitmaps bound the overlap; what may link is compared exactly.
2. What then is not joined yet is compared tile by tile in blocks of about TILE sets: set bits in the difference of two
   bitmaps bound the overlap from above, and the distance is a metric, so that distances to the leader bound it, too.
   Only pairs across components are wanted, and of those the best ones per set and component come first. Pairs that
   pass are compared exactly. Rounds follow, with more pairs per set and component, until no round left any out.

Copies are folded into one set first and unfolded at the end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from profspark.llm.bloom import Bloom
from profspark.llm.components import components
from profspark.llm.scratch import Scratch, packed, unpacked
from profspark.llm.words import SPACED, U64, encoded, mix, shingles, words

TILE = 1024
#: Signatures that a range of them has on average.
RANGE = 1 << 20
#: Signatures, or texts, that a task works on at a time.
DEALT = 1 << 19
TEXTS = 256
WIDEST = 1 << 40


@cache
def bands(p: int, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lowest size, number of segments and spare segments of each band, for 100 * p / q per cent of similarity.

    The smaller of two linked sets, of n shingles, differs from the larger one in n * (q - p) / p shingles at most. The
    first band holds sizes that allow no difference and has no segments. Bands end where the number of segments would
    be too small for their sizes.
    """
    low, segments, spare = [1], [0], [0]
    top = p // (q - p) if (p % (q - p)) else p // (q - p) - 1
    while top < WIDEST:
        low.append(top + 1)
        top = max(top + 1, (top + 1) * 3 // 2)
        most = top * (q - p) // p
        spare.append(1 + most // 16)
        segments.append(most + 1 + spare[-1])
    return np.array(low), np.array(segments), np.array(spare)


def signatures(s: np.ndarray, p: int, q: int) -> list[np.ndarray]:
    """For each band in which the sorted set `s` can meet a linked one, its segments' signatures.

    Empty segments say nothing and would gather unrelated sets. A band has spare segments, so that two sets agree in
    one that is not empty unless both have more empty ones than spares; only such rare sets give their empty ones.
    """
    low, segments, spare = bands(p, q)
    n = len(s)
    out = []
    first = np.searchsorted(low, -(-n * p // q), "right") - 1
    total = np.zeros(n + 1, dtype=U64)
    np.cumsum(mix(s + U64(0x51ED270B0B)), out=total[1:])
    for band in range(max(first, 0), np.searchsorted(low, n, "right")):
        k = int(segments[band])
        if k:
            # Integer cut points of the upper 32 bits; the set is sorted, so segments are runs.
            cuts = (np.arange(k + 1, dtype=U64) << U64(32)) // U64(k)
            edge = np.searchsorted(s >> U64(32), cuts[1:], "left")
            edge = np.concatenate(([0], edge))
            edge[-1] = n
            sums = total[edge[1:]] - total[edge[:-1]]
            sig = mix(sums ^ mix(np.arange(k, dtype=U64) + U64(int(band) << 40)))
            empty = edge[1:] == edge[:-1]
            out.append(sig if empty.sum() > spare[band] else sig[~empty])
    return out


def bitmap(s: np.ndarray) -> np.ndarray:
    """Parity of the shingles that fall on each bit; the number of bits is the power of two from twice the set's size on."""
    bits = 64
    while bits < 2 * len(s):
        bits *= 2
    hit = np.bincount((mix(s ^ U64(0xB17)) & U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(hit.astype(np.uint8), bitorder="little")


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """A bitmap with fewer bits: halves are added, modulo 2."""
    while len(bits) > size:
        half = len(bits) // 2
        bits = bits[:half] ^ bits[half:]
    return bits


def row_key(node: int, doc_id) -> int:
    return int.from_bytes(hashlib.blake2b(f"{node} {doc_id!r}".encode(), digest_size=8).digest(), "little", signed=True)


def _set(text: str | None, size: int) -> np.ndarray:
    return np.unique(shingles(words(encoded(text), SPACED)[0], size))


def _node(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def jaccard_components(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, percent: int = 90, tile: int = TILE
) -> DataFrame:
    """(id, n_shingles, component_id) for each row of `df`, with the id column's own type.

    Words are runs without ASCII white space, A-Z folded. A row's set is its distinct shingles of `size` words; with
    fewer words, the whole sequence. Two rows link from `percent` per cent of Jaccard similarity on. component_id is
    the smallest id that links lead to. Null or empty texts, and texts without words, have no shingles and are linked
    with nothing. Repeated rows are copies. A null id is kept; its component is the smallest other id, if there is one.
    Other columns are not read. Shingles, and whole sets, count as equal when 64-bit hashes of them are.
    """
    scratch = Scratch(df.sparkSession)
    p, q = percent, 100
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_field = T.StructField("id", docs.schema["id"].dataType)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                rows = []
                for d, t in zip(part["id"].to_pylist(), part["text"].to_pylist(), strict=True):
                    s = _set(t, size)
                    node = _node(s)
                    sigs = [g.view(np.int64) for g in signatures(s, p, q)] if len(s) else []
                    rows.append((len(s), node, row_key(node, d), np.concatenate(sigs) if sigs else [], bitmap(s).tobytes()))
                columns = zip(*rows, strict=True)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
                yield pa.RecordBatch.from_arrays([part["id"], *map(pa.array, columns, kinds)], names=["id", "n", "node", "key", "sigs", "bits"])

    longs = [T.StructField(c, T.LongType()) for c in ("n", "node", "key")]
    described = scratch.keep(
        docs.mapInArrow(describe, T.StructType([id_field, *longs, T.StructField("sigs", T.ArrayType(T.LongType())), T.StructField("bits", T.BinaryType())]))
    )
    rows = scratch.keep(described.select("id", "n", "node"))
    # One row speaks for all copies of a set.
    nodes = described.where("n > 0").groupBy("node").agg(F.min(F.struct("key", "n")).alias("own"))
    nodes = scratch.keep(nodes.select("node", "own.*"))
    edges = _links(docs, described, nodes, scratch, size, p, q, tile)
    labels = scratch.keep(components(edges, scratch))
    scratch.drop(nodes, edges)

    labelled = rows.where("n > 0").join(labels, "node", "left").select("id", "n", F.coalesce("label", "node").alias("label"))
    # Written, so that the join has two plain shuffles, of which Spark can split a hot label's rows.
    smallest = scratch.keep(labelled.groupBy("label").agg(F.min("id").alias("component_id")))
    none = rows.where("n = 0").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    found = labelled.join(smallest, "label").select("id", F.col("n").alias("n_shingles"), "component_id")
    return found.unionByName(none).withColumnRenamed("id", id_col)


def representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`df` with one row of each component: the one with the smallest id, and of rows with one id the first by text hash.

    Of repeated rows one stays. Rows without words are linked with nothing and all stay, repeated ones once.
    """
    scratch = Scratch(df.sparkSession)
    own = F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"))
    found = jaccard_components(df.select(own.alias("own"), F.col(text_col).alias("text")), "own", "text", **options)
    kept = found.where(F.col("own").eqNullSafe(F.col("component_id"))).groupBy("own").agg(F.count(F.lit(1)).alias("copies"))
    kept = scratch.keep(kept.select(F.xxhash64("own.id", "own.mark").alias("key"), "own", "copies"))
    rows = packed(df, key=F.xxhash64(F.col(id_col), F.xxhash64(text_col)), own=own)
    named = kept.select("key", F.col("own").alias("kept"), "copies")
    once = rows.join(named.where("copies = 1"), "key").where(F.col("own").eqNullSafe(F.col("kept"))).select("row")
    if not kept.where("copies > 1").isEmpty():
        again = rows.join(named.where("copies > 1"), "key").where(F.col("own").eqNullSafe(F.col("kept")))
        number = F.row_number().over(Window.partitionBy("key", "own").orderBy(F.lit(1)))
        once = once.unionByName(again.withColumn("number", number).where("number = 1").select("row"))
    return unpacked(once)


def _met(described: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(sig, node, mates) of the signatures that several sets have."""
    spark = described.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = described.agg(F.coalesce(F.sum(F.size("sigs")), F.lit(0))).first()[0]
    ranges = max(partitions, -(-total // RANGE))
    speaks = spark.sparkContext.broadcast(Bloom.of(nodes, "key"))

    def of_speakers(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        """The rows that speak for a set, and the signatures of each, about DEALT at a time, however many a batch has; a
        few copies may pass, too."""
        for batch in batches:
            rows = np.flatnonzero(speaks.value.hits(batch["key"].to_numpy()))
            lengths = batch["sigs"].value_lengths().to_numpy()[rows]
            piece = (np.cumsum(lengths, dtype=np.int64) - lengths) // DEALT
            for part in np.split(np.arange(len(rows)), np.flatnonzero(piece[1:] != piece[:-1]) + 1):
                if len(part):
                    yield batch, np.repeat(rows[part], lengths[part]), batch["sigs"].take(pa.array(rows[part])).flatten().to_numpy()

    def by_range(sigs: np.ndarray) -> pa.RecordBatch:
        third = np.zeros(len(sigs), dtype=bool)
        third[2:] = sigs[2:] == sigs[:-2]
        sigs = sigs[~third]
        own = ((sigs.view(U64) >> U64(32)) * U64(ranges)) >> U64(32)
        order = np.argsort(own, kind="stable")
        sigs, own = sigs[order], own[order]
        edge = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1], [True]))) if len(own) else np.zeros(1, dtype=np.int64)
        blobs = [sigs[x:y].tobytes() for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(own[edge[:-1]].astype(np.int64)), pa.array(blobs, pa.binary())], names=["range", "sigs"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for _, _, sigs in of_speakers(batches):
            held, size = [*held, sigs], size + len(sigs)
            if size >= DEALT:
                yield by_range(np.sort(np.concatenate(held)))
                held, size = [], 0
        if held:
            yield by_range(np.sort(np.concatenate(held)))

    def twice(table: pa.Table) -> pa.Table:
        sigs = np.sort(np.concatenate([np.frombuffer(v.as_buffer(), dtype=np.int64) for v in table["sigs"]]))
        return pa.table({"sig": np.unique(sigs[1:][sigs[1:] == sigs[:-1]])})

    dealt = described.select("key", "sigs").mapInArrow(deal, "range long, sigs binary")
    shared = scratch.keep(dealt.groupBy("range").applyInArrow(twice, "sig long"))
    passes = spark.sparkContext.broadcast(Bloom.of(shared, "sig"))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, row, sigs in of_speakers(batches):
            may = passes.value.hits(sigs)
            row, sigs = row[may], sigs[may]
            node, key = (batch[c].to_numpy()[row] for c in ("node", "key"))
            for at in range(0, len(row), 1 << 16):
                k = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(x[k]) for x in (sigs, node, key)], names=["sig", "node", "key"])

    flat = described.select("node", "key", "sigs").mapInArrow(listed, "sig long, node long, key long")
    flat = scratch.keep(flat.join(nodes, ["node", "key"], "left_semi").select("sig", "node").distinct())
    # Aggregates are written, here and below, so that joins have two plain shuffles, of which Spark can split a hot key.
    counts = scratch.keep(flat.groupBy("sig").agg(F.count(F.lit(1)).alias("mates")).where("mates > 1"))
    met = scratch.keep(flat.join(counts, "sig"))
    scratch.drop(shared, flat, counts)
    return met


def _led(met: DataFrame, scratch: Scratch) -> DataFrame:
    """(sig, node, leader): the tiles, each with the set that has the most company over all its tiles."""
    company = scratch.keep(met.groupBy("node").agg(F.sum("mates").alias("company")))
    top = F.max(F.struct("company", "node"))
    leader = scratch.keep(met.join(company, "node").groupBy("sig").agg(top.alias("top")).select("sig", F.col("top.node").alias("leader")))
    led = scratch.keep(met.join(leader, "sig").select("sig", "node", "leader"))
    scratch.drop(company, leader)
    return led


def _links(docs: DataFrame, described: DataFrame, nodes: DataFrame, scratch: Scratch, size: int, p: int, q: int, tile: int) -> DataFrame:
    """Edges (u, v) between sets, enough of them to connect whatever links connect. Drops `described`."""
    met = _met(described, nodes, scratch)
    led = _led(met, scratch)
    need = nodes.join(met.select("node").distinct(), "node", "left_semi").select("node", "key")
    maps = described.join(need, ["node", "key"], "left_semi").select("node", "key", "n", "bits").dropDuplicates(["node"])
    maps = scratch.keep(maps)
    scratch.drop(met, described)

    pairs = led.where("node != leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()
    bounded = scratch.keep(_bounded(pairs, maps, p, q))
    sets = _arrays(docs, bounded.where("may").select("a", "b"), maps, None, scratch, size)
    checked = scratch.keep(_checked(bounded.where("may").select("a", "b"), sets, p, q))
    sure = checked.select("a", "b", F.col("distance").alias("low"), F.col("distance").alias("high"), "linked")
    known = sure.unionByName(bounded.where("not may").select("a", "b", "low", F.lit(1.0).alias("high"), F.lit(False).alias("linked")))
    known = known.withColumnsRenamed({"a": "node", "b": "leader"})
    to_leader, led = led, scratch.keep(led.join(known, ["node", "leader"], "left").select("sig", "node", "leader", "low", "high", "linked"))
    edges = scratch.keep(checked.where("linked").select(F.col("a").alias("u"), F.col("b").alias("v")))
    scratch.drop(to_leader, bounded, checked)

    take = 1
    while True:
        labels = scratch.keep(components(edges, scratch))
        found = scratch.keep(_undecided(led, maps, labels, scratch, p, q, tile, take))
        more = scratch.keep(found.where("a is not null").select("a", "b").distinct())
        if not more.isEmpty():
            sets = _arrays(docs, more, maps, sets, scratch, size)
            new = _checked(more, sets, p, q).where("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))
            before, edges = edges, scratch.keep(edges.unionByName(new).distinct())
            scratch.drop(before)
        done = found.where("a is null").isEmpty()
        scratch.drop(labels, found, more)
        if done:
            scratch.drop(led, maps, sets)
            return edges
        take *= 8


def _bounded(pairs: DataFrame, maps: DataFrame, p: int, q: int) -> DataFrame:
    """The pairs (a, b) with a lower bound of their distance, and whether they may link, by their bitmaps."""
    both = pairs.join(maps.select("node", "n", "bits").toDF("a", "n_a", "bits_a"), "a").join(maps.select("node", "n", "bits").toDF("b", "n_b", "bits_b"), "b")

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b in zip(batch["bits_a"], batch["bits_b"], strict=True):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint8) for v in (a, b))
                least = min(len(x), len(y))
                out.append(int(np.bitwise_count((folded(x, least) ^ folded(y, least)).view(np.uint64)).sum()))
            apart, both_n = np.array(out, dtype=np.int64), batch["n_a"].to_numpy() + batch["n_b"].to_numpy()
            columns = [batch["a"], batch["b"], pa.array(2 * apart / (both_n + apart)), pa.array(apart * (q + p) <= (q - p) * both_n)]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "low", "may"])

    return both.mapInArrow(bound, "a long, b long, low double, may boolean")


def _arrays(docs: DataFrame, pairs: DataFrame, maps: DataFrame, have: DataFrame | None, scratch: Scratch, size: int) -> DataFrame:
    """(node, n, shingles) of the sets in `pairs` (a, b), from the texts again; `have` has some of them already.

    A filter of bounded size keeps most other texts' sets from being moved; the join settles the rest.
    """
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    if have is not None:
        wanted = wanted.join(have.select("node"), "node", "left_anti")
    need = scratch.keep(maps.join(wanted, "node", "left_semi").select("node", "key"))
    if have is not None and need.isEmpty():
        return have
    bloom = docs.sparkSession.sparkContext.broadcast(Bloom.of(need, "key"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part, rows = batch.slice(at, TEXTS), []
                for d, t in zip(part["id"].to_pylist(), part["text"].to_pylist(), strict=True):
                    s = _set(t, size)
                    if len(s):
                        node = _node(s)
                        key = row_key(node, d)
                        if bloom.value.has(key):
                            rows.append((node, key, len(s), s.tobytes()))
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
                    yield pa.RecordBatch.from_arrays([*map(pa.array, zip(*rows, strict=True), kinds)], names=["node", "key", "n", "shingles"])

    found = docs.mapInArrow(read, "node long, key long, n long, shingles binary")
    found = found.join(need, ["node", "key"], "left_semi").dropDuplicates(["node", "key"]).select("node", "n", "shingles")
    sets = scratch.keep(found if have is None else found.unionByName(have))
    scratch.drop(need, *([] if have is None else [have]))
    return sets


def _checked(pairs: DataFrame, sets: DataFrame, p: int, q: int) -> DataFrame:
    """The pairs (a, b) with their exact distance, and whether they link."""
    both = pairs.join(sets.toDF("a", "n_a", "s_a"), "a").join(sets.toDF("b", "n_b", "s_b"), "b")

    def intersect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b in zip(batch["s_a"], batch["s_b"], strict=True):
                x, y = (np.frombuffer(v.as_buffer(), dtype=U64) for v in (a, b))
                out.append(len(np.intersect1d(x, y, assume_unique=True)))
            common = np.array(out, dtype=np.int64)
            union = batch["n_a"].to_numpy() + batch["n_b"].to_numpy() - common
            columns = [batch["a"], batch["b"], pa.array(1 - common / np.maximum(union, 1)), pa.array(q * common >= p * union)]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "distance", "linked"])

    return both.mapInArrow(intersect, "a long, b long, distance double, linked boolean")


def _undecided(led: DataFrame, maps: DataFrame, labels: DataFrame, scratch: Scratch, p: int, q: int, tile: int, take: int) -> DataFrame:
    """Pairs (a, b) of a tile that may link and would join two components, at most `take` per set and component.

    A row of nulls says that pairs were left out. Tiles of one component are done. So are sets in a tile that link to
    its leader, unless another set is near enough to the leader for a link between the two. Distances to the leader are
    exact, or, where bitmaps ruled a link out, at least `low`.
    """
    limit = 1 - p / q + 1e-9
    marked = led.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")).where("node != leader")
    per_tile = marked.groupBy("sig").agg(F.min(F.when(~F.col("linked"), F.col("low"))).alias("nearest"), F.min("label").alias("l1"), F.max("label").alias("l2"), F.count(F.lit(1)).alias("sets"))
    open_tiles = per_tile.where("nearest is not null and l1 != l2").select("sig", "nearest", F.ceil(F.col("sets") / tile).cast("int").alias("blocks"))
    # Written, so that the join has two plain shuffles, of which Spark can split a large tile's rows.
    open_tiles = scratch.keep(open_tiles)
    left = marked.join(open_tiles, "sig").where(~F.col("linked") | (F.col("high") >= F.col("nearest") - limit))
    left = left.join(maps.select("node", "n", "bits"), "node").select("sig", "node", "label", "low", "high", "n", "bits", "blocks")
    # Blocks of about `tile` sets, by a hash.
    left = left.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    left = left.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left = left.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))

    def compare(table: pa.Table) -> pa.Table:
        n, label, low, high = (table[c].to_numpy() for c in ("n", "label", "low", "high"))
        maps = [np.frombuffer(v.as_buffer(), dtype=np.uint8) for v in table["bits"].combine_chunks()]
        shortest = min(map(len, maps))
        bits = np.stack([folded(m, shortest) for m in maps]).view(np.uint64)
        own, same_block = table["own"].to_numpy(), table["lo"][0].as_py() == table["hi"][0].as_py()
        found = []
        step = max(1, (1 << 22) // max(1, bits.size))
        for i in range(0, len(n), step):
            j = slice(i, i + step)
            apart = np.bitwise_count(bits[j, None, :] ^ bits[None, :, :]).sum(axis=2, dtype=np.int64)
            may = (apart * (q + p) <= (q - p) * (n[j, None] + n[None, :])) & (label[j, None] != label[None, :])
            may &= (low[j, None] - high[None, :] <= limit) & (low[None, :] - high[j, None] <= limit)
            if not same_block:
                may &= own[j, None] != own[None, :]
            x, y = np.nonzero(may)
            found.append(np.stack([x + i, y, apart[x, y]]))
        x, y, apart = np.concatenate(found, axis=1)
        order = np.lexsort((apart, label[y], x))
        x, y = x[order], y[order]
        new = np.ones(len(x), dtype=bool)
        new[1:] = (x[1:] != x[:-1]) | (label[y[1:]] != label[y[:-1]])
        first = np.maximum.accumulate(np.where(new, np.arange(len(x)), 0))
        best = np.arange(len(x)) - first < take
        size = len(n)
        code = np.minimum(x, y) * size + np.maximum(x, y)
        chosen = np.unique(code[best])
        node = table["node"].to_numpy()
        a, b = node[chosen // size], node[chosen % size]
        a, b = np.minimum(a, b), np.maximum(a, b)
        short = [None] if len(np.unique(code)) > len(chosen) else []
        return pa.table({"a": pa.array([*a.tolist(), *short], pa.int64()), "b": pa.array([*b.tolist(), *short], pa.int64())})

    return left.drop("other", "blocks").groupBy("sig", "lo", "hi").applyInArrow(compare, "a long, b long")
