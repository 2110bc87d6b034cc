import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from sylva.llm import prefix_trie as P
from sylva.llm.common import table

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    """The nodes of rows (conv_id, turn, role, text), each with its own list of members."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        rebuilt[c] = own.get(base, [])[:h] + turns[h:]
    members = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for name in members:
        if name:
            children.setdefault(name[:-1], []).append(name)
    leaves, saved = {}, {}
    for name in sorted(members, key=len, reverse=True):
        below = children.get(name, [])
        leaves[name] = sum(leaves[x] for x in below) or 1
        words = len(re.findall(r"[^\x20\x09-\x0D]+", name[-1][1])) if name else 0
        saved[name] = sum(saved[x] for x in below) + (len(members[name]) - 1) * words
    out = []
    for name, ids in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in ids if len(rebuilt[c]) == len(name)))
        parent = min(members[name[:-1]]) if name else None
        out.append((min(ids), len(name), parent, len(ids), len(children.get(name, [])), leaves[name], saved[name], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, P.prefix_trie(df).select(*COLUMNS).collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_query_against_plain_version(spark, sf):
    rows = [tuple(r) for r in table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, P.op11_prefix_trie(spark, sf).collect()), key=str) == plain(rows)


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_shared_prefixes_over_any_ranges(spark, partitions):
    rng, rows = random.Random(partitions), []
    for c in rng.sample(range(-60, 400), 200):
        for turn in range(rng.choice([0, 1, 2, 3, 5, 9, 60 if c % 50 == 0 else 4])):
            rows.append((c, turn, rng.choice(["user", "bot", None]), rng.choice(["a b", "a", "", None, "x\x1cy z"]) if rng.random() < 0.6 or turn == 0 else f"say {rng.random()}"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        assert found(frame(spark, rows)) == plain(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_conversation_longer_than_a_range_and_many_equal_ones(spark):
    rng = random.Random(5)
    long = [(41, k, "user", f"t {k}") for k in range(3000)] + [(40, k, "user", f"t {k}") for k in range(2500)] + [(40, k, "bot", "fork") for k in range(2500, 2600)]
    same = [(c, k, "user", f"t {k}") for c in rng.sample(range(100, 5000), 900) for k in range(5)]
    rows = long + same
    rng.shuffle(rows)
    assert found(frame(spark, rows)) == plain(rows)


def test_edges(spark):
    rows = [
        (None, 0, "user", "no conversation"), (1, None, "user", "first"), (1, 0, "bot", None), (1, 0, "bot", None), (1, 0, None, "z"), (1, 0, "a", "y"),
        (2, 5, None, None), (3, 1, "u", "x"), (21, 0, "u", "only base is absent"), (22, 0, "ab", "c"), (23, 0, "a", "bc"), (0, 0, "u", "x " * 5000), (0, 9, "u", "last"),
    ]
    assert found(frame(spark, rows)) == plain(rows)
    more = frame(spark, rows).withColumns({"depth": F.lit(1), "part": F.lit("x"), "k1": F.lit(None).cast("int")})
    assert found(more) == plain(rows)
    assert found(frame(spark, rows).limit(0)) == []


def test_sql_against_plain_version(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
    cursor = con.execute(P.ORACLE)
    place = [[d[0] for d in cursor.description].index(c) for c in COLUMNS]
    rows = [tuple(r) for r in table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r[k] for k in place) for r in cursor.fetchall()), key=str) == plain(rows)
