"""The trie of conversations' prefixes, merged family first.

Conversations are numbered in families of FAMILY ids, of which the first is the base.  A conversation begins with the first
h turns of its base (h by a checksum of its id) in place of its own first h.  Every distinct prefix of the conversations
rebuilt so is a node; its members are the conversations that begin with it.

1. Turns are put in order by one range shuffle, the only one of texts: by conversation, turn (null first), role and text.  A
   turn goes on as the two halves of an MD5 and its number of words.  A conversation that is longer than a range continues in
   the next ones; what comes before is carried by sums, at most two for each range.
2. Turns and the family's heads are cogrouped by base and range, and the family's small trie is built in numpy.  A prefix is
   known by the sums of its turns' hashes, each mixed with the turn's depth, so prefixes that continue in another range have
   the same name there.  Members are a bit each.  A group is a family, or a range's share of it.
3. Nodes of families, not turns, are shuffled by name and merged; counts are added up before the shuffle.
4. A node belongs to its smallest member.  A conversation owns the nodes of its path from some depth on, so sums over a
   subtree need no walk down: every conversation that owns nodes adds its owned part, once, to each node it is a member of.
   One number a conversation goes back to the families for that, and again their nodes are merged.

Nothing is worked out level by level, so depth costs nothing; a family, a first turn or a whole conversation that a third of
the rows have is a key of sums only.  The digest of the ids that end at a node is of one sequence: ids are joined in blocks of
BLOCK by many tasks, and one task for each node digests its blocks one after the other, without holding them.

Edge cases: rows without a conv_id are of no conversation; a null role or text is empty; turns of one number are ordered by
role, then text; a repeated turn counts twice; a conversation may end up without turns and is then a member of the root only;
ids below 0 have their base towards 0, as % has it; further columns don't matter; an empty table has no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import U64, map_arrow, map_batches, materialise, mix, on_workers, parts, table

FAMILY = 20
HEADS = 3  # the most turns taken from a base
BLOCK = 20_000  # ids joined by one task
NAME = ["depth", "k1", "k2"]
_NODES = "base long, depth long, k1 long, k2 long, p1 long, p2 long, words long, n long, mask long, least long, least_tail long, tail long, ends array<long>"


def _unsigned(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.asarray(column).astype(np.int64).view(U64)


def hashes(t1: np.ndarray, t2: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Two numbers for each turn at its depth (from 1); a prefix is known by their sums modulo 2**64."""
    at = mix(depth.astype(U64) * U64(0x9E3779B97F4A7C15))
    return np.stack([mix(t1 ^ at), mix(t2 ^ mix(at))], axis=1)


# ---------------------------------------------------------------- turns in order


def turns_in_order(conversations: DataFrame) -> DataFrame:
    """(part, conv_id, i, t1, t2, words): turns by range and their number in the range's share of the conversation."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).where("conv_id is not null")
    digest = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    order = ["conv_id", "turn", "role", "text", "salt"]  # the last one, so that many equal rows are several ranges'
    rows = rows.withColumns({"digest": digest, "words": words, "salt": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange(parts(conversations.sparkSession), *order).sortWithinPartitions(*order)
    return map_batches(rows.select("conv_id", "digest", "words"), _numbered, "part int, conv_id long, i long, t1 long, t2 long, words long")


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, last, before = TaskContext.get().partitionId(), None, 0
    for b in batches:
        if not b.num_rows:
            continue
        conv = b.column("conv_id").to_numpy()
        start = np.concatenate([[0], np.flatnonzero(conv[1:] != conv[:-1]) + 1])
        size = np.diff(np.append(start, len(conv)))
        i = np.arange(len(conv)) - np.repeat(start, size)
        if conv[0] == last:
            i[: size[0]] += before
        last, before = conv[-1], i[-1] + 1
        digest = np.frombuffer(b"".join(b.column("digest").to_pylist()), "<i8").reshape(-1, 2)
        columns = [np.full(len(conv), part, np.int32), conv, i, digest[:, 0].copy(), digest[:, 1].copy()]
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), b.column("words")], ["part", "conv_id", "i", "t1", "t2", "words"])


def spans(turns: DataFrame) -> DataFrame:
    """A row for each share of a conversation: where it begins, the turns of the base that the conversation begins with,
    and the sums of the shares before it."""
    share = Window.partitionBy("conv_id").orderBy("part")
    earlier = share.rowsBetween(Window.unboundedPreceding, -1)
    found = turns.groupBy("part", "conv_id").agg(F.count("*").alias("n"))
    found = found.select(
        "part", "conv_id", "n",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
        F.sum("n").over(Window.partitionBy("conv_id")).alias("total"),
        F.expr(f"conv_id - conv_id % {FAMILY}").alias("base"),
        F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(HEADS + 1)).alias("h"),
    )
    found = materialise(found, "spans")
    first = turns.where(f"conv_id % {FAMILY} = 0 and i < {HEADS}").join(found.select("part", "conv_id", "before"), ["part", "conv_id"])
    first = first.withColumn("p", F.col("i") + F.col("before")).where(f"p < {HEADS}")
    first = first.groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("p", "t1", "t2", "words"))).alias("heads"))
    found = found.join(first, "base", "left").withColumn("heads", F.expr("slice(coalesce(heads, array()), 1, cast(h as int))"))
    found = found.withColumn("length", F.size("heads") + F.greatest(F.col("total") - F.col("h"), F.lit(0)))
    # Shares of conversations that lie in several ranges: at most the first and the last one of a range.
    split = found.where("total > n").select("part", "conv_id", "before", "h", F.size("heads").alias("k"))
    rows = turns.join(split, ["part", "conv_id"]).where("i + before >= h")
    rows = rows.select("part", "conv_id", F.expr("k + i + before - h + 1").alias("depth"), "t1", "t2", "words")
    sums = map_arrow(rows, _hashed, "part int, conv_id long, g1 long, g2 long, words long")
    exact = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("g1", "g2")]
    sums = split.select("part", "conv_id").join(sums.groupBy("part", "conv_id").agg(*exact, F.sum("words").alias("own")), ["part", "conv_id"], "left")
    wrapped = "pmod(coalesce(%s, 0), 18446744073709551616)"
    sums = sums.select("part", "conv_id", F.sum("g1").over(earlier).alias("g1"), F.sum("g2").over(earlier).alias("g2"), F.sum("own").over(earlier).alias("words_before"), F.sum("own").over(Window.partitionBy("conv_id")).alias("words_all"))
    sums = sums.withColumns({c: F.expr(f"cast(if({wrapped % c} >= 9223372036854775808, {wrapped % c} - 18446744073709551616, {wrapped % c}) as long)") for c in ("g1", "g2")})
    return found.join(sums, ["part", "conv_id"], "left")


def _hashed(b: pa.RecordBatch) -> pa.RecordBatch:
    g = hashes(_unsigned(b.column("t1")), _unsigned(b.column("t2")), b.column("depth").to_numpy()).view(np.int64)
    return pa.RecordBatch.from_arrays([b.column("part"), b.column("conv_id"), pa.array(g[:, 0].copy()), pa.array(g[:, 1].copy()), b.column("words")], ["part", "conv_id", "g1", "g2", "words"])


# ---------------------------------------------------------------- tries of families


def family_nodes(turns: DataFrame, found: DataFrame) -> DataFrame:
    """The nodes of each family's trie, in each range that the family lies in."""
    on_workers(turns.sparkSession)
    turns = turns.withColumn("base", F.expr(f"conv_id - conv_id % {FAMILY}"))
    return turns.groupBy("base", "part").cogroup(found.groupBy("base", "part")).applyInArrow(_family, _NODES)


def _family(turns: pa.Table, found: pa.Table) -> pa.Table:
    found = found.sort_by("conv_id")
    conv, before, h, length = (found.column(c).to_numpy().astype(np.int64) for c in ("conv_id", "before", "h", "length"))
    heads = found.column("heads").to_pylist()
    k = np.array([len(x) for x in heads])
    carried = np.stack([_unsigned(found.column(c).fill_null(0)) for c in ("g1", "g2")], axis=1)
    words_before = found.column("words_before").fill_null(0).to_numpy().astype(np.int64)
    alone = found.column("words_all").is_null().to_numpy()
    head_words = np.array([sum(x["words"] for x in own) for own in heads], np.int64)
    s = np.searchsorted(conv, turns.column("conv_id").to_numpy())
    place = turns.column("i").to_numpy() + before[s]
    keep = np.flatnonzero(place >= h[s])
    s, depth = s[keep], (k[s] + place - h[s] + 1)[keep]
    t1, t2 = (_unsigned(turns.column(c))[keep] for c in ("t1", "t2"))
    words = turns.column("words").to_numpy().astype(np.int64)[keep]
    taken = [(j, d + 1, x["t1"], x["t2"], x["words"]) for j, own in enumerate(heads) for d, x in enumerate(own)]
    if taken:
        more = np.array(taken, np.int64).T
        g = hashes(more[2].view(U64), more[3].view(U64), more[1])
        later = before[more[0]] > 0  # the turns of the base stand in the conversation's first share
        np.add.at(carried, more[0][later], g[later])
        s, depth, words = (np.concatenate([a, b[~later]]) for a, b in ((s, more[0]), (depth, more[1]), (words, more[4])))
        t1, t2 = (np.concatenate([a, b[~later].view(U64)]) for a, b in ((t1, more[2]), (t2, more[3])))
    # The root is the first row of each conversation.
    roots = np.flatnonzero(before == 0)
    root = np.isin(np.arange(len(s) + len(roots)), np.arange(len(s), len(s) + len(roots)))
    g = np.concatenate([hashes(t1, t2, depth), np.zeros((len(roots), 2), U64)])
    s, depth, words = np.concatenate([s, roots]), np.concatenate([depth, 0 * roots]), np.concatenate([words, 0 * roots])
    order = np.lexsort((depth, s))
    s, depth, words, g, root = s[order], depth[order], words[order], g[order], root[order]
    first = np.ones(len(s), bool)
    first[1:] = s[1:] != s[:-1]
    at = np.flatnonzero(first)
    size = np.diff(np.append(at, len(s)))
    name = np.cumsum(g, axis=0)
    name = name - np.repeat((name - g)[at], size, axis=0) + carried[s]
    parent = name - g
    total = np.cumsum(words)
    seen = total - words - np.repeat((total - words)[at], size)  # words of this share before the turn
    start = np.where(before > 0, head_words + words_before, 0)
    every = np.zeros(len(conv), np.int64)
    np.add.at(every, s, words)
    every = np.where(alone, every, head_words + found.column("words_all").fill_null(0).to_numpy().astype(np.int64))
    tail = every[s] - start[s] - seen
    # One row a node.
    order = np.lexsort((conv[s], name[:, 1], name[:, 0], depth))
    s, depth, words, name, parent, tail, root = s[order], depth[order], words[order], name[order], parent[order], tail[order], root[order]
    new = np.ones(len(s), bool)
    new[1:] = (depth[1:] != depth[:-1]) | (name[1:] != name[:-1]).any(axis=1)
    at = np.flatnonzero(new)
    base = found.column("base")[0].as_py()
    bits = np.int64(1) << (conv[s] - base + FAMILY - 1)
    n = np.diff(np.append(at, len(s)))
    ending = depth == length[s]
    to = np.concatenate([[0], np.cumsum(np.add.reduceat(ending, at))]) if len(at) else np.zeros(1)
    signed = [x.view(np.int64) for x in (np.ascontiguousarray(name[at]), np.ascontiguousarray(parent[at]))]
    columns = {
        "base": np.full(len(at), base), "depth": depth[at], "k1": signed[0][:, 0].copy(), "k2": signed[0][:, 1].copy(), "p1": signed[1][:, 0].copy(), "p2": signed[1][:, 1].copy(),
        "words": words[at], "n": n, "mask": np.bitwise_or.reduceat(bits, at) if len(at) else bits, "least": conv[s][at], "least_tail": tail[at], "tail": np.add.reduceat(tail, at) if len(at) else tail,
    }
    ends = pa.ListArray.from_arrays(pa.array(to.astype(np.int32)), pa.array(conv[s][ending]))
    return pa.Table.from_arrays([*(pa.array(c.astype(np.int64)) for c in columns.values()), ends], [*columns, "ends"])


# ---------------------------------------------------------------- the operator


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row a node: depth, name (k1, k2), the parent's name (p1, p2), conv_id (smallest member), parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens (words that members after the first don't need again, in the subtree), and ends_sha256
    of the members that end there."""
    turns = materialise(turns_in_order(conversations), "turns")
    found = materialise(spans(turns), "spans")
    nodes = materialise(family_nodes(turns, found), "family-nodes")
    merged = nodes.groupBy(*NAME).agg(
        F.min("least").alias("conv_id"), F.sum("n").alias("n_convs"), F.sum("tail").alias("tail_all"), F.sum(F.size("ends")).alias("n_ends")
    )
    merged = materialise(merged, "nodes")
    # Written first, so that the joins have an exchange on both sides and AQE can split a hot node.
    placed = materialise(nodes.drop("words", "n", "tail", "ends").join(merged, NAME), "placed")
    owned = placed.where("least = conv_id").groupBy("base", "least").agg(
        F.min("depth").alias("from"), F.max("depth").alias("to"), F.max("least_tail").alias("words"), F.max(F.expr("int(n_convs = n_ends)")).alias("leaf")
    )
    bit = F.expr(f"shiftleft(1L, cast(least - base + {FAMILY - 1} as int))").alias("bit")
    owned = owned.groupBy("base").agg(F.collect_list(F.struct(bit, "from", "to", "words", "leaf")).alias("owned"))
    placed = placed.join(materialise(owned, "owned"), "base", "left").withColumn("owned", F.expr("filter(owned, c -> (c.bit & mask) <> 0)"))
    added = {
        "n_children": "int(c.from <= depth + 1 and depth + 1 <= c.to)",
        "n_leaves": "c.leaf",
        "distinct": "if(c.from > depth, c.words, 0L)",
    }
    placed = placed.withColumns({c: F.expr(f"aggregate(coalesce(owned, array()), 0L, (a, c) -> a + {x})") for c, x in added.items()})
    placed = placed.withColumn("distinct", F.expr("distinct + if(least = conv_id, least_tail, 0L)"))
    own = [*NAME, "p1", "p2", "conv_id", "n_convs", "tail_all"]
    out = placed.groupBy(*own).agg(*[F.sum(c).alias(c) for c in added])
    parents = merged.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    out = out.join(parents, ["depth", "p1", "p2"], "left").join(_ends(nodes), NAME, "left")
    return out.select(
        *NAME, "p1", "p2", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        F.expr("tail_all - distinct").alias("saved_tokens"),
        F.coalesce("sha", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def _ends(nodes: DataFrame) -> DataFrame:
    """(name, sha): digests of the ids that end at a node, in order, joined by commas."""
    rows = nodes.where("size(ends) > 0").withColumn("block", F.expr(f"base div {BLOCK}"))
    rows = rows.groupBy(*NAME, "block").agg(F.sort_array(F.flatten(F.collect_list("ends"))).alias("ids"))
    rows = rows.select(*NAME, "block", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))
    rows = rows.repartition(parts(nodes.sparkSession), *NAME).sortWithinPartitions(*NAME, "block")
    return map_batches(rows, _digested, "depth long, k1 long, k2 long, sha string")


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, sha = None, hashlib.sha256()
    for b in batches:
        done = []
        for *name, ids in zip(*(b.column(c).to_pylist() for c in (*NAME, "ids"))):
            if name != at:
                if at is not None:
                    done.append((*at, sha.hexdigest()))
                at, sha = name, hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([*map(pa.array, zip(*done))], [*NAME, "sha"])
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*at, sha.hexdigest())], [*NAME, "sha"])


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = prefix_trie(table(spark, sf_dir, "conversations"))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


#: A CRC-32 bit by bit: a byte is mixed in at every eighth step.
_CRC = """xor(list_reduce(list_concat([4294967295::bigint], flatten(list_transform(range(1, length(s) + 1), lambda i: [ord(substring(s, i, 1))::bigint, 0, 0, 0, 0, 0, 0, 0]))),
    lambda a, v: xor(xor(a, v) // 2, (xor(a, v) % 2) * 3988292384)), 4294967295)"""

ORACLE = rf"""
with turns as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) - 1 as p
  from conversations where conv_id is not null),
ids as (select conv_id, {_CRC} % 4 as h from (select conv_id, conv_id::varchar as s from (select distinct conv_id from turns))),
rebuilt as (
  select i.conv_id, t.role, t.text, t.p as q from ids i join turns t on t.conv_id = i.conv_id - i.conv_id % {FAMILY} and t.p < i.h
  union all
  select i.conv_id, t.role, t.text, t.p + {HEADS + 1} as q from ids i join turns t on t.conv_id = i.conv_id and t.p >= i.h),
numbered as (
  select conv_id, row_number() over (partition by conv_id order by q) as depth, md5(length(role) || ':' || role || text) as turn,
    len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as words from rebuilt),
paths as (
  select conv_id, depth, words, string_agg(turn, '') over (partition by conv_id order by depth rows unbounded preceding) as name from numbered
  union all select conv_id, 0, 0, '' from ids),
ends as (select conv_id, max(depth) as last from paths group by conv_id),
nodes as (
  select name, p.depth, min(p.conv_id) as conv_id, count(*) as n_convs, min(words) as words,
    sha256(coalesce(string_agg(case when last = p.depth then p.conv_id::varchar end, ',' order by p.conv_id), '')) as ends_sha256
  from paths p join ends e on e.conv_id = p.conv_id group by name, p.depth),
children as (select left(name, 32 * (depth::int - 1)) as name, depth - 1 as depth, count(*) as n from nodes where depth > 0 group by 1, 2),
below as (
  select left(x.name, 32 * a::int) as name, a as depth, sum((x.n_convs - 1) * x.words) as saved, count(*) filter (where x.leaf) as leaves
  from (select m.*, c.n is null as leaf, unnest(range(0, m.depth + 1)) as a from nodes m left join children c on c.name = m.name and c.depth = m.depth) x
  group by 1, 2)
select m.conv_id, m.depth, f.conv_id as parent_conv_id, m.n_convs, coalesce(c.n, 0) as n_children, b.leaves as n_leaves,
  b.saved::bigint as saved_tokens, m.ends_sha256
from nodes m join below b on b.name = m.name and b.depth = m.depth
left join children c on c.name = m.name and c.depth = m.depth
left join nodes f on f.depth = m.depth - 1 and f.name = left(m.name, 32 * (m.depth::int - 1))
"""
