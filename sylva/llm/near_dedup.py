"""Near-duplicate detection: BagMinHash signatures, banding, exact verification of multiset overlap.

A document is the multiset of its runs of five words (see common.word_hashes for what a word is).  Its
signature has BANDS * ROWS registers.  Every (shingle, dyadic interval of multiplicities) carries a Poisson
process in time and multiplicity whose points are a function of the shingle alone; a document sees the points
below its own multiplicity, and a register keeps the first point that hits it.  Two documents' registers agree
with a probability that is their weighted Jaccard similarity.

Equal texts are one node (known by their MD5, and from then on by a number).  Nodes that share a band are compared, first
with the most central node of the bucket, and then, where a bucket holds more than one component after that, across
components.  A pair counts as a link only when the exact weighted Jaccard similarity of the two texts is at least the
threshold.  Classes are the connected components of the links.

Across components, nodes meet by the rarest of their shingles.  Sort a text's shingles by how many nodes have them.  What two
texts of similarity 0.8 share begins somewhere; in front of that rarest common shingle neither can have more weight than the
similarity leaves it: about a ninth, or a fifth of the larger one.  So only shingles there are an index (an exact prefix and
position filter, by weights).  What only one component has lies in front, so two families that resemble each other too
little never meet, however large they are.  Nodes that do meet are compared by wide signatures in groups of bounded size,
and pairs that agree there are verified: in a first round the best of each node, in a second one all that lie in different
components after that.

With 25 bands of 5 rows a pair of similarity 0.8 shares a band with probability 0.99995.  Nothing is capped: large groups
are split, and a node's partners into groups.

Edge cases: a null text is the empty text; texts without words are near-duplicates of nothing, not even of each
other; texts of 1 to 4 words have one shingle; repeated rows are copies; documents without doc_id get a class
by their text like others, and class_id is the smallest doc_id of the class (null if none has one); an empty table
gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import U64, chunks, discard, map_arrow, map_batches, materialise, mix, parts, sealed, shingles, spread, table, texts_of, unit, word_hashes

BANDS, ROWS, THRESHOLD = 25, 5, 0.8
REGISTERS = BANDS * ROWS
#: Registers of the wider signatures that decide which pairs across components are verified, and how many of the
#: first WIDE >> 3 and of all have to agree: five standard deviations below similarity 0.8.
WIDE = 1024
AGREE = {m: int(m * (THRESHOLD - 5 * (THRESHOLD * (1 - THRESHOLD) / m) ** 0.5)) for m in (WIDE >> 3, WIDE)}
BLOCK, GROUP = 512, 64
#: Shares of a text's weight that it has in common with any text of similarity THRESHOLD that isn't larger, or isn't smaller.
LONG, SHORT = THRESHOLD, 2 * THRESHOLD / (1 + THRESHOLD)


# ---------------------------------------------------------------- signatures


def bags(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts: shingles (sorted within a text), their multiplicities, and where each text's begin."""
    h, begin = shingles(*word_hashes(texts))
    doc = np.repeat(np.arange(len(texts)), np.diff(begin))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return h[at], np.diff(np.append(at, len(h))), np.searchsorted(doc[at], np.arange(len(texts) + 1))


def bag_minhash(h: np.ndarray, weight: np.ndarray, begin: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """Signatures (texts x m) of weighted sets: in each register the time of its first point.

    Interval j of an element covers multiplicities [2**(j-1), 2**j), interval 0 covers [0, 1).  Points of an
    interval come at a rate in proportion to its length, each with a multiplicity in it and a register.
    """
    n = len(begin) - 1
    top = np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64)  # the last interval reached
    item = np.repeat(np.arange(len(h)), top + 1)
    level = np.arange(len(item)) - np.repeat(np.cumsum(top + 1) - (top + 1), top + 1)
    low = np.where(level > 0, 2.0 ** (level - 1), 0.0)
    length = np.maximum(low, 1.0)
    doc = np.repeat(np.arange(n), np.diff(begin))[item]
    seed, limit = mix(h[item] + level.astype(U64) * U64(0x632BE59BD9B4E019)), weight[item].astype(np.float64)
    time, step = np.zeros(len(item)), np.zeros(len(item), U64)
    first = np.full(n * m, np.inf)
    while len(seed):
        k = max(1, min(64, 60_000 // len(seed)))  # several points at once when few elements are left
        ids = mix(seed[:, None] + (step[:, None] + np.arange(1, k + 1, dtype=U64)) * U64(0x9E3779B97F4A7C15))
        gaps = -np.log(unit(ids)) / (m * length[:, None])
        times = np.cumsum(np.concatenate([time[:, None], gaps], axis=1), axis=1)[:, 1:]
        other = mix(ids ^ U64(0xA0761D6478BD642F))
        register = ((other & U64(0xFFFFFFFF)) * U64(m)) >> U64(32)
        height = low[:, None] + (other >> U64(32)).astype(np.float64) * 2.0**-32 * length[:, None]
        seen = height < limit[:, None]
        cell = doc[:, None] * m + register.astype(np.int64)
        np.minimum.at(first, cell[seen], times[seen])
        worst = first.reshape(n, m).max(axis=1)
        go = times[:, -1] < worst[doc]
        seed, doc, low, length, limit = seed[go], doc[go], low[go], length[go], limit[go]
        time, step = times[go, -1], step[go] + U64(k)
    return first.reshape(n, m)


def band_keys(signature: np.ndarray) -> np.ndarray:
    bits = mix(signature.view(U64)).reshape(len(signature), BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=U64)[None, :] * U64(0x9E3779B97F4A7C15)
    for r in range(ROWS):
        key = mix(key ^ bits[:, :, r]) + U64(r + 1)
    return key.view(np.int64)


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, key (MD5 of the text), size (number of shingles) and bands."""

    def sign(b: pa.RecordBatch) -> pa.Table:
        texts, out = texts_of(b), []
        for lo, hi in chunks(texts):
            h, weight, begin = bags(texts[lo:hi])
            signature = bag_minhash(h, weight, begin)
            size = np.add.reduceat(np.append(weight, 0), np.minimum(begin[:-1], len(weight))) * (np.diff(begin) > 0)
            keys = band_keys(signature)
            offsets = np.concatenate([[0], np.cumsum(np.where(size > 0, BANDS, 0))]).astype(np.int32)
            out.append(
                pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id").slice(lo, hi - lo),
                        b.column("key").slice(lo, hi - lo),
                        pa.array(size.astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[size > 0].ravel())),
                    ],
                    ["doc_id", "key", "size", "bands"],
                )
            )
        return pa.Table.from_batches(out)

    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType), *T.StructType.fromDDL("key binary, size long, bands array<long>")]
    return map_arrow(docs.select("doc_id", key_of().alias("key"), "text"), sign, T.StructType(fields))


def sketched(text: DataFrame) -> DataFrame:
    """id, size, and a byte of each register of a wide signature, of (id, text)."""

    def sketch(b: pa.RecordBatch) -> pa.Table:
        texts, out = texts_of(b), []
        for lo, hi in chunks(texts):
            h, weight, begin = bags(texts[lo:hi])
            wide = (mix(bag_minhash(h, weight, begin, WIDE).view(U64)) & U64(255)).astype(np.uint8)
            size = [int(weight[a:z].sum()) for a, z in zip(begin[:-1], begin[1:])]
            columns = [b.column("id").slice(lo, hi - lo), pa.array(size, pa.int64()), pa.array([s.tobytes() for s in wide], pa.binary())]
            out.append(pa.RecordBatch.from_arrays(columns, ["id", "size", "sketch"]))
        return pa.Table.from_batches(out)

    return map_arrow(text.select("id", "text"), sketch, "id long, size long, sketch binary")


def key_of() -> Column:
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))


# ---------------------------------------------------------------- verification


def similar(pairs: DataFrame, text: DataFrame, threshold: float) -> DataFrame:
    """Of pairs (a, b) of ids, those whose texts have a weighted Jaccard similarity of at least `threshold`.

    text: (id, text), one row an id.  Partners of one `a` are dealt into groups of about GROUP; each group
    gets the text of `a` once.
    """
    pairs = materialise(pairs, "pairs")
    # Written first, so that AQE can split the join at a hot node.
    many = materialise(pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).alias("groups")), "many")
    dealt = pairs.join(many, "a").select("a", "b", F.expr("pmod(xxhash64(b, 'group'), groups)").alias("g"))
    wanted = dealt.select("a", "g", F.col("b").alias("id"), F.lit(1).alias("side")).union(
        dealt.select("a", "g", F.col("a").alias("id"), F.lit(0).alias("side")).distinct()
    )
    grouped = wanted.join(text, "id").repartition(parts(text.sparkSession), "a", "g").sortWithinPartitions("a", "g", "side")
    return map_batches(grouped, _verifier(threshold), "a long, b long")


def _verifier(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, at = None, None  # the sorted shingles of the current `a`
        for batch in batches:
            texts = texts_of(batch)
            a, g, ids, side = (batch.column(c).to_pylist() for c in ("a", "g", "id", "side"))
            found = []
            for lo, hi in chunks(texts):
                h, weight, begin = bags(texts[lo:hi])
                for i in range(lo, hi):
                    own = slice(begin[i - lo], begin[i - lo + 1])
                    if side[i] == 0:
                        head, at = (h[own].copy(), weight[own].copy()), (a[i], g[i])
                    elif at == (a[i], g[i]) and overlap(*head, h[own], weight[own]) >= threshold:
                        found.append((a[i], ids[i]))
            if found:
                yield _pairs(found)

    return run


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b"])


def overlap(h: np.ndarray, w: np.ndarray, other: np.ndarray, v: np.ndarray) -> float:
    """The weighted Jaccard similarity of two multisets with sorted elements."""
    if not len(h) or not len(other):
        return 0.0
    at = np.minimum(np.searchsorted(h, other), len(h) - 1)
    both = np.minimum(w[at], v)[h[at] == other].sum()
    return both / (w.sum() + v.sum() - both)


# ---------------------------------------------------------------- components


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the connected components of edges (a, b): the smallest node of each, by alternating
    large and small stars.  A hot node is only ever an aggregation key or a side of a join that AQE splits."""
    e = materialise(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges"
    )
    before = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        new = materialise(small.where("u <> v").distinct(), "edges")
        state = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(e)
        e = new
        if state == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state


# ---------------------------------------------------------------- candidates


def first_pairs(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Buckets of two nodes and more as (band, id, size, n), and each bucket's central node with its others.

    Central is the node whose buckets hold the most nodes in all: among the copies of an original, the original.
    """
    rows = nodes.select("id", "size", F.explode("bands").alias("band"))
    count = rows.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialise(rows.join(count, "band"), "buckets")
    central = shared.groupBy("id").agg(F.sum("n").alias("score"))
    scored = shared.join(central, "id")
    head = scored.groupBy("band").agg(F.max(F.struct("score", "id", "size")).alias("head"))
    pairs = (
        shared.join(head, "band")
        .where("head.id <> id and least(size, head.size) >= greatest(size, head.size) * 0.8 - 1e-9")
        .select(F.col("head.id").alias("a"), F.col("id").alias("b"))
        .distinct()
    )
    return shared, pairs


class Crossing:
    """Pairs of nodes in different components, of buckets that hold several, whose wide signatures agree enough."""

    def __init__(self, shared: DataFrame, text: DataFrame, roots: DataFrame):
        labelled = shared.join(roots, shared["id"] == roots["node"], "left").select("band", "id", F.coalesce("root", "id").alias("root"))
        mixed = labelled.groupBy("band").agg((F.min("root") < F.max("root")).alias("mixed")).where("mixed")
        # Written first, so that AQE can split a hot bucket.
        self.open = materialise(labelled.join(materialise(mixed, "mixed"), "band").select("id").distinct(), "open")
        text = text.join(self.open, "id", "left_semi")
        self.prefixes = materialise(prefixes(text), "prefixes")
        member = _grouped(self._of(roots))
        self.sketches = materialise(sketched(text.join(member.select("id").distinct(), "id", "left_semi")), "sketches")

    def _of(self, roots: DataFrame) -> DataFrame:
        own = self.open.join(roots, self.open["id"] == roots["node"], "left").select("id", F.coalesce("root", "id").alias("root"))
        return self.prefixes.join(materialise(own, "roots"), "id")

    def pairs(self, roots: DataFrame, best: bool) -> DataFrame:
        """best: of a node and a shingle, only the partner that agrees most."""
        return _compared(materialise(_grouped(self._of(roots)), "members"), self.sketches, best).distinct()


def prefixes(text: DataFrame) -> DataFrame:
    """(shingle, id, before, short) of (id, text): the rarest shingles of each text, such that any two texts of similarity
    THRESHOLD have one in common.  before: the weight of rarer ones; short: it also suffices for the smaller of two."""

    def spell(b: pa.RecordBatch) -> pa.Table:
        texts, out = texts_of(b), []
        for lo, hi in chunks(texts):
            h, weight, begin = bags(texts[lo:hi])
            ids = np.repeat(b.column("id").to_numpy()[lo:hi], np.diff(begin))
            size = np.repeat(np.diff(np.concatenate([[0], np.cumsum(weight)])[begin]), np.diff(begin))
            out.append(pa.RecordBatch.from_arrays([pa.array(ids), pa.array(h.view(np.int64)), *(pa.array(c.astype(np.int64)) for c in (weight, size))], ["id", "shingle", "weight", "size"]))
        return pa.Table.from_batches(out)

    rows = materialise(map_arrow(text.select("id", "text"), spell, "id long, shingle long, weight long, size long"), "shingles")
    # Written first, so that AQE can split the join at a frequent shingle.  What one text alone has stands in front of all.
    count = materialise(rows.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1"), "frequent")
    order = Window.partitionBy("id").orderBy("n", "shingle")
    before = F.coalesce(F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.col("size") - F.sum("weight").over(Window.partitionBy("id"))
    placed = rows.join(count, "shingle").withColumn("before", before + rest)
    least = "before <= size - ceil(size * %r - 1e-9)"
    return placed.where(least % LONG).select("shingle", "id", "before", F.expr(least % SHORT).alias("short"))


def _grouped(rows: DataFrame) -> DataFrame:
    """Of (shingle, id, before, short, root), the shingles of several components, with groups: (own, g), where own is the component
    that has the group to itself, or -1 for the nodes of small components."""
    count = rows.groupBy("shingle", "root").agg(F.count("*").alias("n"), F.max("short").alias("short"))
    open_ = count.groupBy("shingle").agg(
        F.min("root").alias("one"), F.max("root").alias("two"), F.max("short").alias("any"), F.sum(F.when(F.col("n") < BLOCK // 2, F.col("n")).otherwise(0)).alias("small")
    )
    count = count.drop("short").join(open_.where("one < two and any"), "shingle").select(
        "shingle", "root", F.expr(f"if(n < {BLOCK // 2}, -1L, root)").alias("own"), F.expr(f"cast(ceil(if(n < {BLOCK // 2}, small, n) / {BLOCK}) as int)").alias("groups")
    )
    return rows.join(count, ["shingle", "root"]).withColumn("g", F.expr("cast(pmod(xxhash64(id, 'block'), groups) as int)"))


def _compared(member: DataFrame, sketches: DataFrame, best: bool) -> DataFrame:
    """Pairs across components, of the groups of a shingle that may hold some."""
    group = member.groupBy("shingle", "own", "g").agg(F.max("short").alias("short"))
    left, right = (group.select("shingle", *[F.col(c).alias(f"{c}{k}") for c in ("own", "g", "short")]) for k in (1, 2))
    meets = left.join(right, "shingle").where("(own1 < own2 or own1 = own2 and g1 <= g2) and (own1 <> own2 or own1 = -1) and (short1 or short2)")
    meets = materialise(meets.drop("short1", "short2"), "meets")
    key = ["shingle", "own1", "g1", "own2", "g2"]
    own = member.select("shingle", "before", "own", "g", "id", "root")
    one = own.join(meets, (own["shingle"] == meets["shingle"]) & (own["own"] == meets["own1"]) & (own["g"] == meets["g1"])).drop(meets["shingle"])
    two = meets.where("own1 <> own2 or g1 <> g2")
    two = own.join(two, (own["shingle"] == two["shingle"]) & (own["own"] == two["own2"]) & (own["g"] == two["g2"])).drop(two["shingle"])
    sides = one.select(*key, F.lit(1).alias("side"), "before", "id", "root").union(two.select(*key, F.lit(2).alias("side"), "before", "id", "root"))
    rows = sides.join(sketches, "id").select(*key, "side", "before", "id", "root", "size", "sketch")
    rows = rows.repartition(parts(member.sparkSession), *key).sortWithinPartitions(*key, "id")
    return map_batches(rows, _crossing(best), "a long, b long")


def _crossing(best: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("shingle", "own1", "g1", "own2", "g2", "side", "before", "id", "root", "size", "sketch")]
            found: list[tuple[int, int]] = []
            for row in zip(*columns):
                if held and held[0][:5] != row[:5]:
                    found += _block(held, best)
                    held = []
                held.append(row)
            if found:
                yield _pairs(found)
        if held and (found := _block(held, best)):
            yield _pairs(found)

    return run


def _block(rows: list[tuple], best: bool) -> list[tuple[int, int]]:
    """Pairs of two groups that meet, or of one group with itself."""
    if len({r[8] for r in rows}) < 2:
        return []
    sketch = np.frombuffer(b"".join(r[10] for r in rows), np.uint8).reshape(len(rows), WIDE)
    size = np.array([r[9] for r in rows], np.float64)
    root = np.unique([r[8] for r in rows], return_inverse=True)[1]
    side, across = np.array([r[5] for r in rows]), rows[0][1:3] != rows[0][3:5]
    rest = size - np.array([r[6] for r in rows])  # what two texts share at most, if this is the rarest shingle that they do
    one, two, agree = [], [], []
    for i in range(len(rows) - 1):
        other = size[i + 1 :]
        ok = root[i + 1 :] != root[i]
        ok &= np.minimum(other, size[i]) >= np.maximum(other, size[i]) * THRESHOLD - 1e-9
        ok &= np.minimum(rest[i + 1 :], rest[i]) >= (other + size[i]) * (SHORT / 2) - 1e-9
        if across:
            ok &= side[i + 1 :] != side[i]
        j = i + 1 + np.flatnonzero(ok)
        for m, least in AGREE.items():
            same = (sketch[j, :m] == sketch[i, :m]).sum(axis=1)
            j, same = j[same >= least], same[same >= least]
        one.append(np.full(len(j), i))
        two.append(j)
        agree.append(same)
    i, j, same = map(np.concatenate, (one, two, agree))
    if best:
        most = np.zeros(len(rows), np.int64)
        np.maximum.at(most, i, same)
        np.maximum.at(most, j, same)
        first = np.full(len(rows), len(i))
        np.minimum.at(first, i, np.where(same == most[i], np.arange(len(i)), len(i)))
        np.minimum.at(first, j, np.where(same == most[j], np.arange(len(i)), len(i)))
        taken = np.unique(first[first < len(i)])
        i, j = i[taken], j[taken]
    return [(rows[a][7], rows[b][7]) for a, b in zip(i.tolist(), j.tolist())]


# ---------------------------------------------------------------- the operator


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, key, class_key): one row for each row of docs; rows of one class_key are near-duplicates.

    class_key is null for texts without words.
    """
    signs = materialise(signed(docs), "signatures")
    # Copies of a text have the same bands, so any row stands for them all.
    nodes = signs.where("size > 0").groupBy("key").agg(F.first("size").alias("size"), F.first("bands").alias("bands"))
    nodes = materialise(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")
    shared, pairs = first_pairs(nodes)
    # Copies meet before the shuffle: a text is sent once from each task at most.
    text = docs.select(key_of().alias("key"), "text").groupBy("key").agg(F.first("text").alias("text"))
    wanted = nodes.select("id", "key").join(shared.select("id").distinct(), "id")
    text = materialise(text.join(wanted, "key").select("id", "text"), "texts")
    links = materialise(similar(pairs, text, THRESHOLD), "links")
    roots = components(links)
    # First each node with the one that it agrees with most, then whatever is still in different components.
    crossing = Crossing(shared, text, roots)
    for best in (True, False):
        links = materialise(links.union(similar(crossing.pairs(roots, best), text, THRESHOLD)), "links")
        roots = components(links)
    roots = materialise(roots, "roots")
    named = nodes.select("id", "key").join(roots, nodes["id"] == roots["node"], "left").select("key", F.coalesce("root", "id").alias("class_key"))
    return signs.select("doc_id", "key").join(named, "key", "left")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of the class) and class_size, one row for each row of docs."""
    found = materialise(near_duplicates(docs), "classes")
    least = found.where("class_key is not null").groupBy("class_key").agg(
        F.min("doc_id").alias("class_id"), F.count("*").alias("class_size")
    )
    # Written first, so that the join has an exchange on both sides and AQE can split a hot class.
    return found.join(materialise(least, "least"), "class_key", "left").select(
        "doc_id",
        F.when(F.col("class_key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"),
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """The columns of docs, with one row of each class: of its smallest doc_id, then its smallest text key.

    Rows without words are all kept.
    """
    plain, undo = sealed(docs, "doc_id", "text")
    found = materialise(near_duplicates(plain), "classes")
    best = (
        found.where("class_key is not null")
        .groupBy("class_key")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("best"))
        .select(_row_name(F.col("best.key"), F.col("best.doc_id")).alias("__row"))
    )
    named = plain.withColumn("__row", _row_name(key_of(), F.col("doc_id")))
    # Equal (doc_id, text) rows are copies of each other: one of them stays.  The join has dealt them by the same name,
    # so the texts are shuffled once.
    kept = named.join(materialise(best, "best"), "__row", "left_semi").dropDuplicates(["__row"]).select(*plain.columns)
    return undo(kept.unionByName(plain.where(~F.coalesce("text", F.lit("")).rlike(r"[0-9A-Za-z]|[^\x00-\x7F]"))))


def _row_name(key: Column, doc_id: Column) -> Column:
    return F.concat(F.hex(key), F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit("")))


def op8_bagminhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spread(table(spark, sf_dir, "documents")))
