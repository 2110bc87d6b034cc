import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sylva.llm import simhash as S
from sylva.llm.common import table


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [words[k : k + 3] for k in range(len(words) - 2)] if len(words) > 2 else [words] * bool(words)
    h = [xxhash.xxh64(" ".join(r).encode(), seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute(prints, radius=2):
    """Of rows (id, fingerprint), each one's smallest reachable id."""
    nodes = np.array(sorted({f for _, f in prints}), np.uint64)
    parent = list(range(len(nodes)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(nodes)):
        for j in np.flatnonzero(np.bitwise_count(nodes[:i] ^ nodes[i]) <= radius):
            parent[root(i)] = root(int(j))
    at = {int(f): root(k) for k, f in enumerate(nodes)}
    least = {}
    for i, f in prints:
        if i is not None:
            least[at[f]] = min(i, least.get(at[f], i))
    return [(i, f"{f:016x}", least.get(at[f])) for i, f in prints]


def family(rng, n, flips):
    base, out = rng.getrandbits(64), []
    for _ in range(n):
        f = base
        for _ in range(rng.randint(0, flips)):
            f ^= 1 << rng.randrange(64)
        out.append(f)
    return out


def found(df):
    return sorted(map(tuple, df.select("doc_id", "fingerprint", "component_id").collect()), key=str)


@pytest.mark.parametrize("tile, blocks", [(2048, None), (7, None), (3, 1), (5, 2), (4, 4), (50, 8), (2, 16)])
def test_links_connect_what_all_pairs_connect(spark, tile, blocks):
    rng = random.Random(tile)
    prints = [f for _ in range(12) for f in family(rng, 15, 4)] + [rng.getrandbits(64) for _ in range(200)] + [0, 1, 3, 2**64 - 1, 2**63, 2**63 - 1]
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in set(prints)], "node long")
    edges = [(r.a % 2**64, r.b % 2**64) for r in S.links(nodes, tile=tile, blocks=blocks).collect()]
    assert all((a ^ b).bit_count() in (1, 2) for a, b in edges)
    parent = {f: f for f in prints}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for a, b in edges:
        parent[root(a)] = root(b)
    want = brute(list(enumerate(prints)))
    groups = {}
    for k, (_, _, component) in enumerate(want):
        groups.setdefault(component, set()).add(root(prints[k]))
    assert all(len(g) == 1 for g in groups.values())
    assert len({g for s in groups.values() for g in s}) == len(groups)


def test_dense_groups_give_a_forest(spark):
    nodes = np.arange(256, dtype=np.uint64)
    pairs = S.compared(nodes, None, 2)
    assert len(pairs) == 255
    assert len(S.compared(nodes[:128], nodes[128:], 2)) <= 255


def test_fingerprints(spark):
    texts = ["", None, " \t", "One", "one TWO", "one two three", "A b c d a b c d", "É é word Ärger", "x\x1cy z", "a b c " * 50, "a\vb\fc\rd"]
    texts += [" ".join(random.Random(k).choices("abcdefgh", k=40)) for k in range(20)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.fingerprint % 2**64 for r in S.fingerprints(docs).collect()}
    assert got == {k: plain(t) for k, t in enumerate(texts)}


def test_long_texts_are_counted_in_pieces(monkeypatch):
    text = " ".join(random.Random(3).choices(["ab", "cd", "ef", "gh"], k=1000))
    whole = S.fingerprint(text.encode())
    monkeypatch.setattr(S, "AT_ONCE", 7)
    assert S.fingerprint(text.encode()) == whole == plain(text)


def test_query_against_all_pairs(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text").collect()
    assert found(S.op13_simhash_near_dedup(spark, sf)) == sorted(brute([(d.doc_id, plain(d.text)) for d in docs]), key=str)


def test_edges(spark):
    rows = [(None, "a b c d"), (7, "a b c d"), (3, "A B C D"), (3, "A B C D"), (9, None), (8, ""), (None, "p q r s"), (5, "z " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"fingerprint": F.lit(1), "component.id": F.lit(2)})
    assert found(S.classes(docs)) == sorted(brute([(i, plain(t)) for i, t in rows]), key=str)
    named = docs.withColumn("doc_id", F.col("doc_id").cast("string"))
    assert {r.component_id for r in S.classes(named).where("doc_id in ('7', '3')").collect()} == {"3"}
    assert S.classes(docs.limit(0)).count() == 0
