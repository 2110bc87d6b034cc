import random
from collections import Counter

import numpy as np

from sylva.llm import near_dedup as N


def bag(text):
    words, word = [], ""
    for c in (text or "").lower() + " ":
        if c.isascii() and not c.isalnum():
            words += [word] * bool(word)
            word = ""
        else:
            word += c
    return Counter(tuple(words[k : k + 5]) for k in range(max(len(words) - 4, 1))) if words else Counter()


def brute(texts):
    """The class (smallest index) of every text, over all pairs."""
    bags, parent = [bag(t) for t in texts], list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both, either = sum((bags[i] & bags[j]).values()), sum((bags[i] | bags[j]).values())
            if either and both / either >= 0.8:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(k) for k in range(len(texts))]


def family(rng, n, size=120):
    """A text and copies with a few words changed, more in each."""
    base = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(size)]
    out = []
    for k in range(n):
        words = list(base)
        for _ in range(rng.randint(0, 4) if k else 0):
            words[rng.randrange(size)] = "z" + str(rng.randint(0, 9999))
        out.append(" ".join(words))
    return out


def test_against_all_pairs(spark):
    rng = random.Random(4)
    texts = [t for k in range(12) for t in family(rng, rng.randint(1, 12))] + family(rng, 60)
    texts += ["", None, "", "...", "...", "one two", "One, two!", "one two three", "a b c d e f " * 40, "a b c d e f " * 41, "a b c d e f " * 80]
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in N.classes(docs).collect()}
    want = brute(texts)
    assert [got[k].class_id for k in range(len(texts))] == want
    sizes = Counter(want)
    assert all(got[k].class_size == sizes[want[k]] for k in range(len(texts)))


def crowd(rng, n, shared=60, own=48):
    """Texts with a long common passage, few of them near-duplicates: buckets with many small components."""
    passage = [f"p{k}" for k in range(shared)]
    out = []
    for k in range(n):
        words = [f"o{rng.randint(0, 10**6)}" for _ in range(own)]
        out.append(" ".join(passage + words))
        if k % 5 == 0:
            words[rng.randrange(own)] = "changed"
            out.append(" ".join(passage + words))
    return out


def test_crowded_buckets(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 16)
    rng = random.Random(8)
    texts = crowd(rng, 150) + family(rng, 90) + [family(rng, 2)[1] for _ in range(3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute(texts)
    got = {r.doc_id: r.class_id for r in N.classes(docs).collect()}
    assert [got[k] for k in range(len(texts))] == want and len(set(want)) < len(texts) - 80


def near_families(rng, n, apart=0.14, size=200, mark=""):
    """Two families of n near copies each, of which the originals have a similarity of about 0.75 where apart is 0.14: no
    text of one is a near-duplicate of one of the other."""
    base = [f"{mark}w{k}" for k in range(size)]
    other = [f"{mark}v{k}" if k < round(size * apart) else w for k, w in enumerate(base)]
    out = []
    for words in (base, other):
        for _ in range(n):
            own = list(words)
            for _ in range(rng.randint(0, 2)):
                own[rng.randrange(round(size * 0.5), size)] = f"z{rng.randint(0, 10**6)}"
            out.append(" ".join(own))
    return out


def crossing(spark, texts, monkeypatch):
    """The classes, and how many pairs across components were verified."""
    found, real = [], N.Crossing.pairs

    def counted(*args):
        pairs = N.materialise(real(*args), "counted")
        found.append(pairs.count())
        return pairs

    monkeypatch.setattr(N.Crossing, "pairs", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r.class_id for r in N.classes(docs).collect()}, sum(found)


def test_families_that_are_not_near_enough_never_meet(spark, monkeypatch):
    texts = near_families(random.Random(4), 150)
    got, pairs = crossing(spark, texts, monkeypatch)
    assert pairs <= 150 and len(set(got.values())) == 2
    assert [got[k] for k in range(len(texts))] == brute(texts)


def test_links_across_components_are_found_by_rare_shingles(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 16)
    rng = random.Random(7)
    texts = [t for k, apart in enumerate((0.05, 0.09, 0.1, 0.11, 0.12)) for t in near_families(rng, 30, apart, mark=f"f{k}")]
    got, _ = crossing(spark, texts, monkeypatch)
    assert [got[k] for k in range(len(texts))] == brute(texts)


def test_prefixes_meet_wherever_texts_are_near(spark):
    rng = random.Random(11)
    texts = [t for _ in range(6) for t in family(rng, 8, 40)] + ["a b c d e f " * k for k in (9, 10, 11, 12)] + near_families(rng, 6, 0.1, 60)
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    own = [{}, {}]
    for r in N.prefixes(frame).collect():
        own[0].setdefault(r.id, set()).add(r.shingle)
        if r.short:
            own[1].setdefault(r.id, set()).add(r.shingle)
    bags = [bag(t) for t in texts]
    near = 0
    for i in range(len(texts)):
        for j in range(i):
            a, b = sorted((i, j), key=lambda k: sum(bags[k].values()))
            if sum((bags[i] & bags[j]).values()) >= 0.8 * sum((bags[i] | bags[j]).values()) and texts[i] != texts[j]:
                near += 1
                assert own[1].get(a, set()) & own[0].get(b, set())
    assert near > 20


def test_documents_against_all_pairs(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: r.class_id for r in N.op8_bagminhash_near_dedup(spark, sf).collect()}
    want = brute([r.text for r in rows])
    assert got == {r.doc_id: rows[k].doc_id for r, k in zip(rows, want)}


def test_one_of_each_class_stays(spark):
    text = " ".join(f"w{k}" for k in range(100))
    rows = [(5, text, 1), (3, text + " more", 2), (3, text + " more", 2), (7, "other words here", 3), (8, "", 4), (9, None, 5), (9, None, 5), (None, "alone and unlike all others", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key int")
    kept = N.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.key) for r in kept.collect()) == [(0, 6), (3, 2), (7, 3), (8, 4), (9, 5), (9, 5)]
    assert N.classes(docs.limit(0)).count() == 0 and N.keep_first(docs.limit(0)).count() == 0


def test_ids_as_text_and_clashing_columns(spark):
    rows = [("007", "a b c d e f", 1, 2, 3), ("7", "a b c d e f", 4, 5, 6), (None, "x", 7, 8, 9)]
    kept = N.keep_first(spark.createDataFrame(rows, "doc_id string, text string, __row int, `a.b` int, class_key int"))
    assert kept.columns == ["doc_id", "text", "__row", "a.b", "class_key"]
    assert sorted((tuple(r) for r in kept.collect()), key=str) == sorted([rows[0], rows[2]], key=str)


def test_signatures_estimate_weighted_jaccard():
    rng = random.Random(1)
    errors = []
    for k in range(60):
        words = [f"w{rng.randint(0, 300)}" for _ in range(200)]
        other = words[: 200 - k * 2] + [f"v{rng.randint(0, 300)}" for _ in range(k * 2)] + words[:20] * (k % 4)
        h, w, at = N.bags([" ".join(words), " ".join(other)])
        s = N.bag_minhash(h, w, at, 512)
        exact = N.overlap(h[: at[1]], w[: at[1]], h[at[1] :], w[at[1] :])
        errors.append((s[0] == s[1]).mean() - exact)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.03


def test_signature_does_not_depend_on_the_batch():
    rng = random.Random(2)
    texts = [" ".join(f"w{rng.randint(0, 50)}" for _ in range(rng.randint(1, 300))) for _ in range(30)]
    together = N.bag_minhash(*N.bags(texts))
    for k, t in enumerate(texts):
        assert (N.bag_minhash(*N.bags([t]))[0] == together[k]).all()


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(250)] + [(k, k + 1) for k in range(400, 440)] + [(500, k) for k in range(501, 560)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    found = {r.node: r.root for r in N.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found.get(x, x) == root(x) for x in parent)
    assert N.components(spark.createDataFrame([], "a long, b long")).count() == 0
