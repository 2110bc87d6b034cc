"""Near-duplicates by SimHash: fingerprints of 64 bits, compared exactly in tiles.

A document is its runs of three words, repeats included (the whole sequence if it has fewer words), each hashed by XXH64; a
bit of its fingerprint is set if it is set in over half of the hashes.  Two documents are linked if their fingerprints differ
in at most RADIUS bits, and classes are the connected components of the links.

Equal fingerprints are one node.  Nodes are laid out by the population counts of the fingerprint's blocks: fingerprints that
differ in r bits have counts that differ by at most r, added up over the blocks, so only tiles whose counts are that near
meet, and all others are skipped.  There are 1, 2, 4, 8 or 16 blocks, the fewest for which no combination of counts holds much
more than a tile; one that does is dealt into several tiles.  Two tiles are compared in numpy, by exclusive-or and bit
counts, all pairs of them; of the links found, those that join two components of the two tiles' nodes go on, so a dense group
gives as many links as nodes, not their square.  Any number of blocks and any tile size give the same classes.

Edge cases: a null text is the empty text; texts without words have the fingerprint zero, which is linked like any other;
rows without a doc_id have a component like others, and component_id is the smallest doc_id of it (null if none has one);
repeated rows stay; doc_id may be of any type that has an order; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, map_batches, materialise, parts, spread, table
from .near_dedup import components

WORDS, SEED, RADIUS = 3, 42, 2
TILE = 2048
BLOCKS = (1, 2, 4, 8, 16)
AT_ONCE = 1 << 18  # hashes whose bits are counted, or pairs that are compared, at once


# ---------------------------------------------------------------- fingerprints


def fingerprint(text: bytes) -> int:
    """The fingerprint of a text in UTF-8, unsigned."""
    words = text.lower().split()  # bytes: A-Z, and the characters U+0009 to U+000D and U+0020
    if not words:
        return 0
    joined = b" ".join(words)
    length = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(length + 1) - 1
    start, end = end - length, end[WORDS - 1 :] if len(words) >= WORDS else end[-1:]
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    spans = zip(start[: len(end)].tolist(), end.tolist())
    count, n = np.zeros(64, np.int64), len(end)
    for lo in range(0, n, AT_ONCE):
        k = min(AT_ONCE, n - lo)
        h = np.fromiter((digest(view[a:b], SEED) for _, (a, b) in zip(range(k), spans)), np.uint64, k)
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(k, 8), axis=1, bitorder="little")
        count += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(count * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (the 64 bits as a long), one row for each row of docs."""

    def work(b: pa.RecordBatch) -> pa.RecordBatch:
        found = [fingerprint(t or b"") for t in b.column("text").cast(pa.binary()).to_pylist()]
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.array(found, np.uint64).view(np.int64))], ["doc_id", "fingerprint"])

    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("fingerprint", T.LongType())]
    return map_arrow(docs.select("doc_id", "text"), work, T.StructType(fields))


# ---------------------------------------------------------------- tiles


def _base(blocks: int) -> int:
    """Digits for the counts of a block: a power of two with room for RADIUS more, and so that a count below 0 is none."""
    return 1 << (64 // blocks + RADIUS).bit_length()


def cell(node: Column, blocks: int) -> Column:
    """The population counts of a fingerprint's blocks, as the digits of one number."""
    size, base, out = 64 // blocks, _base(blocks), F.lit(0).cast("long")
    for k in range(blocks):
        mask = ((1 << size) - 1) << (size * k)
        out = out + F.bit_count(node.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))).cast("long") * F.lit(base**k)
    return out


def near_cells(blocks: int, radius: int) -> list[int]:
    """What to add to a cell's number for all cells whose counts differ from its by at most radius, each pair of cells once."""
    base, out = _base(blocks), set()
    moves = [(sign * base**k) for k in range(blocks) for sign in (1, -1)]
    for n in range(radius + 1):
        out |= {sum(step) for step in product(moves, repeat=n)}
    return sorted(d for d in out if d >= 0)


def _blocks(nodes: DataFrame, tile: int) -> int:
    """The fewest blocks for which no cell holds more than four tiles."""
    cells = F.array(*[F.struct(F.lit(b).alias("b"), cell(F.col("node"), b).alias("cell")) for b in BLOCKS])
    count = nodes.select(F.explode(cells).alias("c")).groupBy("c.b", "c.cell").count()
    most = {r["b"]: r["most"] for r in count.groupBy("b").agg(F.max("count").alias("most")).collect()}
    return next((b for b in BLOCKS if most.get(b, 0) <= 4 * tile), BLOCKS[-1])


def links(nodes: DataFrame, radius: int = RADIUS, tile: int = TILE, blocks: int | None = None) -> DataFrame:
    """(a, b): pairs of fingerprints that differ in 1 to radius bits, enough to connect all that such pairs connect.

    nodes: distinct fingerprints (node).
    """
    if radius > RADIUS:
        raise ValueError(f"the cells are laid out for a radius of up to {RADIUS}")
    blocks = blocks or _blocks(nodes, tile)
    placed = nodes.select("node", cell(F.col("node"), blocks).alias("cell"))
    cells = materialise(placed.groupBy("cell").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles")), "cells")
    placed = materialise(placed.join(cells, "cell").select("node", "cell", F.expr("cast(pmod(xxhash64(node), tiles) as int)").alias("tile")), "placed")
    one = cells.select(F.col("cell").alias("cell1"), F.col("tiles").alias("n1"), F.explode(F.array(*map(F.lit, near_cells(blocks, radius)))).alias("step"))
    one = one.withColumn("cell2", F.col("cell1") + F.col("step"))
    meets = one.join(cells.select(F.col("cell").alias("cell2"), F.col("tiles").alias("n2")), "cell2")
    meets = meets.select("cell1", "cell2", F.explode(F.sequence(F.lit(0), F.col("n1") - 1)).alias("tile1"), "n2")
    meets = meets.select("cell1", "tile1", "cell2", F.explode(F.sequence(F.lit(0), F.col("n2") - 1)).alias("tile2"))
    meets = materialise(meets.where("cell1 < cell2 or tile1 <= tile2"), "meets")
    key = ["cell1", "tile1", "cell2", "tile2"]
    left = placed.toDF("node", "cell1", "tile1").join(meets, ["cell1", "tile1"]).select(*key, F.lit(1).alias("side"), "node")
    right = placed.toDF("node", "cell2", "tile2").join(meets.where("cell1 < cell2 or tile1 < tile2"), ["cell2", "tile2"])
    rows = left.union(right.select(*key, F.lit(2).alias("side"), "node"))
    rows = rows.repartition(parts(nodes.sparkSession), *key).sortWithinPartitions(*key, "side")
    return map_batches(rows, _comparer(radius), "a long, b long")


def _comparer(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # columns of the rows of two tiles, the last of which may go on
        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("cell1", "tile1", "cell2", "tile2", "side", "node")], axis=1)
            rows = np.concatenate([*held, rows])
            cut = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(axis=1)) + 1
            groups = np.split(rows, cut)
            held = [groups.pop()]
            yield from _found(groups, radius)
        yield from _found(held, radius)

    return run


def _found(groups: list[np.ndarray], radius: int) -> Iterator[pa.RecordBatch]:
    for rows in groups:
        first, nodes = rows[:, 4] == 1, rows[:, 5].copy().view(np.uint64)
        pairs = compared(nodes[first], nodes[~first] if not first.all() else None, radius)
        if len(pairs):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, k].copy().view(np.int64)) for k in (0, 1)], ["a", "b"])


def compared(one: np.ndarray, two: np.ndarray | None, radius: int) -> np.ndarray:
    """Pairs of a node of one and a node of two (None: of one too) that differ in at most radius bits, as a forest."""
    nodes = one if two is None else np.concatenate([one, two])
    parent = list(range(len(nodes)))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    out, other = [], nodes if two is None else two
    offset = 0 if two is None else len(one)
    step = max(1, AT_ONCE // max(len(other), 1))
    for lo in range(0, len(one), step):
        near = np.bitwise_count(one[lo : lo + step, None] ^ other[None, :]) <= radius
        for i, j in zip(*(x.tolist() for x in np.nonzero(near))):
            i, j = lo + i, offset + j
            if (a := root(i)) != (b := root(j)):
                parent[b] = a
                out.append((i, j))
    return nodes[np.array(out, np.int64).reshape(-1, 2)]


# ---------------------------------------------------------------- the operator


def classes(docs: DataFrame, radius: int = RADIUS, tile: int = TILE, blocks: int | None = None) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits) and component_id, one row for each row of docs."""
    prints = materialise(fingerprints(docs), "fingerprints")
    least = materialise(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")).withColumnRenamed("fingerprint", "node"), "nodes")
    roots = components(links(least.select("node"), radius, tile, blocks))
    named = materialise(least.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "named")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialise(named.join(ids, "root").select(F.col("node").alias("fingerprint"), "component_id"), "components")
    # Written first, so that AQE can split a fingerprint that many rows have.
    out = prints.join(named, "fingerprint")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op13_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spread(table(spark, sf_dir, "documents")))
