"""Best-fit packing of tokenised documents, planned on the histogram of lengths.

Documents become pieces of at most `capacity` tokens.  Only the counts by length (at most `capacity`
numbers) reach the driver; best-fit decreasing runs over those counts and yields runs of slots.  A piece
takes its slot by its rank among the pieces of its length, found with salted windows, so neither a hot
length nor a hot source lands in one task.

Edge cases: a null text is the empty text; an empty text is one piece, the end id alone; an empty table gives
an empty table; repeated rows are packed as often as they occur; other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import struct
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import kept, map_arrow, materialise, spread, table, texts_of

CAPACITY = 2048
PIECES = "piece int, start long, length long, ids_crc32 long, place int"


class PieceCache(dict):
    """The ids, as little-endian 32-bit integers, of the pieces that the tokenizer cuts a text into.

    A text of Latin-1 characters is lower-cased and cut by the tokenizer's own pattern, spelled out for Latin-1;
    pieces recur, so most of them are found here.  Other texts, and those with a special token or with one of the
    separators U+001C to U+001F, are left to the tokenizer.
    """

    LETTER, DIGIT, SPACE = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾", "\t\n\x0b\x0c\r \x85\xa0"
    PATTERN = f"[{LETTER}]+|'(?:s|t|re|ve|m|ll|d)|[{DIGIT}]|[^{LETTER}{DIGIT}{SPACE}]+"

    def __init__(self, path: str, limit: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.find, self.odd = re.compile(self.PATTERN.encode("latin-1")).findall, re.compile(r"<\||[\x1c-\x1f]").search
        # Byte-level alphabet: printable Latin-1 stands for itself, the other bytes follow from U+0100 on.
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        rest = (b for b in range(256) if b not in plain)
        self.alphabet = {b: 256 + k for k, b in enumerate(rest)}

    def __missing__(self, piece: bytes) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        text = piece.decode("latin-1")
        if not (text.isascii() and text.isprintable()):
            text = text.encode().decode("latin-1").translate(self.alphabet)
        out = self[piece] = _raw([t.id for t in self.tokenizer.model.tokenize(text)])
        return out

    def encode(self, text: str) -> bytes:
        if not self.odd(text):
            try:
                return b"".join(map(self.__getitem__, self.find(text.lower().encode("latin-1"))))
            except UnicodeEncodeError:
                pass
        return _raw(self.tokenizer.encode(text, add_special_tokens=False).ids)


def _raw(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


_encoders: dict[str, PieceCache] = kept({})


def encoder(path: str) -> PieceCache:
    """One per Python worker and tokenizer file, kept from task to task while these are of one module."""
    if path not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path] = PieceCache(path)
    return _encoders[path]


def cut(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, the CRC-32 of its ids, and the place of its row in the batch."""
    end = _raw([end_id])

    def pieces(b: pa.RecordBatch) -> pa.RecordBatch:
        out = [[], [], [], [], []]
        encode = encoder(tokenizer_path).encode
        for place, text in enumerate(texts_of(b)):
            raw = encode(text) + end
            for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                part = raw[at : at + 4 * capacity]
                for column, value in zip(out, (k, at // 4, len(part) // 4, zlib.crc32(part), place)):
                    column.append(value)
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
        doc = b.column("doc_id").take(pa.array(out[4], pa.int64()))
        return pa.RecordBatch.from_arrays([doc, *(pa.array(c, k) for c, k in zip(out, kinds))], ["doc_id", "piece", "start", "length", "ids_crc32", "place"])

    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType), *T.StructType.fromDDL(PIECES)]
    return map_arrow(docs.select("doc_id", "text"), pieces, T.StructType(fields))


@dataclass
class Run:
    """Pieces of one length with ranks from `rank`: `copies` in each of `bins` sequences from `sequence`.

    The last bin may take fewer: `count` pieces in all, the first of a bin at `offset`.
    """

    length: int
    rank: int
    count: int
    copies: int
    sequence: int
    offset: int


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    """Best-fit decreasing over counts.  Equal sequences are held as (first number, how many) by room left."""
    runs: list[Run] = []
    groups: dict[int, list[tuple[int, int]]] = {}  # room left -> sequences
    heap_of_rooms: set[int] = set()
    made = 0

    def put(room: int, sequence: int, bins: int) -> None:
        if bins and room:
            groups.setdefault(room, []).append((sequence, bins))
            heap_of_rooms.add(room)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        rooms = [r for r in heap_of_rooms if r >= length]
        heapq.heapify(rooms)
        while left:
            if rooms:
                room = rooms[0]
                sequence, bins = groups[room].pop()
                if not groups[room]:
                    heapq.heappop(rooms)
                    heap_of_rooms.discard(room)
            else:
                room, sequence, bins = capacity, made, -(-left // (capacity // length))
                made += bins
            copies = room // length
            full = min(bins, left // copies)
            taken = full * copies
            put(room - copies * length, sequence, full)
            if full < bins and taken < left:  # the last pieces of this length share one sequence
                put(room - (left - taken) * length, sequence + full, 1)
                put(room, sequence + full + 1, bins - full - 1)
                taken = left
            elif full < bins:
                put(room, sequence + full, bins - full)
            runs.append(Run(length, rank, taken, copies, sequence, capacity - room))
            left, rank = left - taken, rank + taken
    return runs


def ranked(pieces: DataFrame, counts: dict[int, int]) -> DataFrame:
    """Adds `rank` (from 0, without gaps) among the pieces of equal length.

    A length is split into buckets of about `grain` pieces by a hash; the number of buckets is bounded
    (65,536 plus one a length), so the running sum over them stays small at any size.
    """
    spark = pieces.sparkSession
    grain = max(256, -(-sum(counts.values()) // 65_536))
    split = spark.createDataFrame(
        [(n, max(1, -(-c // grain))) for n, c in counts.items()] or [(0, 1)], "length long, buckets int"
    )
    dealt = pieces.join(F.broadcast(split), "length").withColumn(
        "bucket", F.expr("cast(pmod(xxhash64(doc_id, piece, ids_crc32, place), buckets) as int)")  # place: many rows may be equal
    )
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = (
        dealt.groupBy("length", "bucket")
        .agg(F.count("*").alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .drop("n")
    )
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    return (
        dealt.withColumn("k", F.row_number().over(within))
        .join(F.broadcast(first), ["length", "bucket"])  # at most 65,536 + capacity rows
        .withColumn("rank", F.col("before") + F.col("k") - 1)
        .drop("bucket", "buckets", "before", "k")
    )


def pack(
    docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int = 0
) -> DataFrame:
    """Pieces of all documents with their sequence_id and offset; see the module for the edge cases."""
    spark = docs.sparkSession
    pieces = materialise(cut(docs, tokenizer_path or default_tokenizer(), capacity, end_id), "pieces")
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("length", "r0", "n", "copies", "seq0", "at0")])
    runs = spark.createDataFrame(
        [(r.length, r.rank, r.count, r.copies, r.sequence, r.offset) for r in plan(counts, capacity)], schema
    )
    # The plan has a few runs a length however many documents there are, so it is broadcast.
    placed = ranked(pieces, counts).join(F.broadcast(runs), "length").where("rank >= r0 and rank < r0 + n")
    return placed.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        F.expr("seq0 + (rank - r0) div copies").alias("sequence_id"),
        F.expr("at0 + (rank - r0) % copies * length").alias("offset"),
    )


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spread(table(spark, sf_dir, "documents")))
