import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from sylva.llm import periodic_runs as P
from sylva.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(x, min_words=24, min_periods=3):
    """All runs, by trying every period at every place."""
    n, found = len(x), {}
    for q in range(1, n // min_periods + 1):
        i = 0
        while i + q < n:
            if x[i] != x[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and x[i] == x[i + q]:
                i += 1
            e = i + q
            if e - s >= max(min_words, min_periods * q) and not any(a <= s and e <= b and q % p == 0 for (a, b), p in found.items()):
                found[s, e] = q
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def digests(doc_id, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words)
    dropped = {k for s, length, q in found for k in range(s + q, s + length)}
    best = (None,) * 4
    if found:
        s, length, q = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]))
        best = (s, length, q, 1000 * length // q)
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    sha = [hashlib.sha256(t.encode()).hexdigest() for t in (listed, " ".join(w for k, w in enumerate(words) if k not in dropped))]
    return (len(found), *best, *sha)


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


def thue_morse(n):
    return ["ab"[bin(k).count("1") % 2] for k in range(n)]


@pytest.mark.parametrize("least", [(24, 3), (3, 3), (6, 3), (4, 4)])
def test_runs_against_every_period_at_every_place(least):
    rng = random.Random(7)
    cases = [["a"] * 60, ["a", "b"] * 40, fibonacci(200), thue_morse(300), [], ["a"], ["a", "a"]]
    for _ in range(150):
        x = []
        while len(x) < rng.randint(1, 120):
            piece = rng.choices("abc"[: rng.randint(1, 3)], k=rng.randint(1, 9))
            x += (piece * rng.randint(1, 6))[: rng.randint(1, 40)]
        cases.append(x)
    for x in cases:
        assert P.runs(x, *least) == brute(x, *least), x


def test_colliding_hashes_are_found_out(monkeypatch):
    monkeypatch.setattr(P.Extensions, "_equal", staticmethod(lambda *a: True))
    for x in (["a", "b", "c"] * 30 + ["d"] + ["a", "b", "c"] * 10, thue_morse(200), ["a"] * 50):
        lce = P.Extensions(["abcd".index(w) for w in x])
        for i, j in ((0, 3), (3, 9), (1, 40), (5, 45)):
            k = 0
            while j + k < len(x) and x[i + k] == x[j + k]:
                k += 1
            assert lce.forward(i, j) == k
            k = 0
            while k < i and x[i - 1 - k] == x[j - 1 - k]:
                k += 1
            assert lce.backward(i, j) == k


def test_long_periodic_text_takes_linear_time():
    words = [f"w{k}" for k in range(997)] * 60
    assert P.runs(words) == [(0, len(words), 997)]
    assert P.runs(["a"] * 100_000) == [(0, 100_000, 1)]
    assert len(P.runs(fibonacci(30_000))) > 100


def test_query_against_plain_version(spark, sf):
    got = {r.doc_id: tuple(r)[1:] for r in P.op12_periodic_runs(spark, sf).collect()}
    docs = table(spark, sf, "documents").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d in docs:
        if len(d.text or "") < 12_000:
            assert got[d.doc_id] == digests(d.doc_id, d.text), d.doc_id


def test_edges(spark):
    texts = [None, "", " \n", "a", "a b " * 40, "x\x1cy\x85z w " * 30, "é ü " * 30 + "end", "a\tb\vc\fd\r" * 9, "one two three " * 8 + "."]
    ids = list(range(len(texts))) + [k for k in range(100, 400) if zlib.crc32(str(k).encode()) % 10 == 0]
    texts += ["a b c d e f g h i j k l m n o p q r s t u v w x y z " * 2] * (len(ids) - len(texts))
    docs = spark.createDataFrame(list(zip(ids, texts)) + [(4, "a b " * 40)], "doc_id long, text string")
    docs = docs.withColumn("text", P.with_periods(F.col("text"), F.col("doc_id")))
    out, runs, collapsed = P.find_runs(docs)
    rows = [(r.doc_id, [tuple(x) for x in r[runs]], r[collapsed]) for r in out.collect()]
    assert len(rows) == len(ids) + 1
    for k, text in zip(ids, texts):
        n, *_, listed, sha = digests(k, text)
        for row in (r for r in rows if r[0] == k):
            assert len(row[1]) == n and hashlib.sha256(row[2].encode()).hexdigest() == sha
            assert hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in row[1]).encode()).hexdigest() == listed


def test_further_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a b " * 30, 1, 2), (1, None, 3, 4)], "doc_id long, text string, runs int, Collapsed int")
    docs = docs.withColumn("a.b", F.lit("x"))
    out, runs, collapsed = P.find_runs(docs)
    assert out.columns == [*docs.columns, "runs_", "collapsed_"] == [*docs.columns, runs, collapsed]
    rows = {r["doc_id"]: r for r in out.collect()}
    assert rows[None]["runs"] == 1 and rows[None]["a.b"] == "x" and rows[None][runs] == [(0, 60, 2)] and rows[None][collapsed] == "a b"
    assert rows[1][runs] == [] and rows[1][collapsed] == ""
    assert P.find_runs(docs.limit(0))[0].count() == 0
