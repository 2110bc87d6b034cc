import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sylva.llm import packing as P


def check(rows, texts, capacity=2048):
    """rows against texts (a list of (doc_id, text)): every piece once, sequences gapless and within capacity."""
    tokenizer = Tokenizer.from_file(P.default_tokenizer())
    want = []
    for doc, text in texts:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want.append((doc, k, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=key) == sorted(want, key=key)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


ODD = [
    "Ünïcode ﬁ ½ ² a'S don't's I'LL ''s ",
    "\x1ca\x1fb",
    "x<|endoftext|>y <|startoftext|>",
    "İSTANBUL ΑΣ Σ ß",
    "é å ÷×ªº_ __a_b ­soft\xa0nb\x85x \x00\x01",
    "😀 12 ½½ ٣",
    "ÀÈÞ ÿ µ 'rex 'll",
    None,
    "",
    "word " * 5000,
]


def test_odd_texts_and_repeated_rows(spark):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(3, ODD[3]), (3, ODD[3]), (None, "a b")]
    out = P.pack(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as length", "2 as piece"))
    check(out.collect(), rows)


def test_documents_and_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = P.op4_best_fit_packing(spark, sf).collect()
    used = check(rows, [(r.doc_id, r.text) for r in docs.collect()])
    assert used <= -(-sum(r.length for r in rows) // 2048) + 1
    assert P.pack(docs.limit(0)).count() == 0


def test_equal_rows_are_ranked_in_many_buckets(spark):
    docs = spark.createDataFrame([(None, "a b c")] * 3000, "doc_id long, text string")
    cut = P.materialise(P.cut(docs, P.default_tokenizer()), "pieces")
    ranks = P.ranked(cut, {r[0]: r[1] for r in cut.groupBy("length").count().collect()})
    assert sorted(r["rank"] for r in ranks.collect()) == list(range(3000))
    assert ranks.select("place").distinct().count() > 100


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 60), max_size=15))
def test_plan_is_best_fit_decreasing(counts):
    capacity = 40
    rooms = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = [r for r in rooms if r >= length]
            if fits:
                rooms.remove(min(fits))
                rooms.append(min(fits) - length)
            else:
                rooms.append(capacity - length)
    runs = P.plan(counts, capacity)
    places, seen = {}, {}
    for r in runs:
        for j in range(r.count):
            places.setdefault(r.sequence + j // r.copies, []).append((r.offset + j % r.copies * r.length, r.length))
            seen.setdefault(r.length, []).append(r.rank + j)
    assert {k: sorted(v) for k, v in seen.items()} == {k: list(range(c)) for k, c in counts.items()}
    assert len(places) == len(rooms)
    for found in places.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= capacity


@pytest.mark.parametrize("text", [t for t in ODD if t])
def test_piece_cache(text):
    cache = P.PieceCache(P.default_tokenizer(), limit=3)
    ids = cache.tokenizer.encode(text, add_special_tokens=False).ids
    assert cache.encode(text) == struct.pack(f"<{len(ids)}I", *ids)


def test_ids_of_any_type(spark):
    docs = spark.createDataFrame([("a1", "some words"), (None, None), ("b2", "x " * 3000)], "doc_id string, text string")
    rows = P.pack(docs).collect()
    assert sorted({r.doc_id for r in rows if r.doc_id}) == ["a1", "b2"] and sum(r.doc_id is None for r in rows) == 1
    assert sum(r.doc_id == "b2" for r in rows) == 2
