"""Conversation prefix trie: double-array tries of prefix shards, whose shared upper nodes are merged globally.

Each conversation is rebuilt: the first h turns of its base (the conversation whose id ends its hundred), then its own
turns from the h-th on. A turn is 128 bits of its role and text and its length, so texts are shuffled once, to be ordered.
Conversations with equal turns count as one sequence; the digest of their ids is worked out over a sorted stream.
A sequence belongs to the shard of its first 2, 4, 8, ... turns, the fewest that at most TOGETHER sequences share: a hot
prefix is split by what follows it. Nodes above that depth are upper ones and may stand in many shards; deeper nodes stand
in one. A shard gives its turns dense ids, packs its trie into BASE and CHECK, and walks its sequences through them for the
nodes' figures. Upper nodes are summed by a digest of their prefix, and what is below a node is summed along the ancestors
that each upper node carries.

Cases: rows without conv_id are ignored; null roles and texts count as empty; turns are ordered by turn (null first), ties
by role and text; repeated rows are turns of their own; a conversation without turns of its own after the h-th and without
a base is a member of the root alone; an empty table has no nodes; other columns are ignored. A conversation is one row
(20 bytes a turn), however long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, table, written

#: Turns that a conversation may take from its base (h is below this), conversations of one base.
SHARED_TURNS, HUNDRED = 6, 100

#: Sequences that share a prefix and stay together, and sequences of a shard, about.
TOGETHER, SHARD = 128, 256

NO_MEMBER = hashlib.sha256(b"").hexdigest()
ROOT_KEY = bytes(16)


def rebuilt(rows: DataFrame) -> DataFrame:
    """Rows of conversations -> (conv_id, turns): one row a conversation, turns an array of (t1, t2, chars)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text")).filter("conv_id is not null")
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    turn = F.struct(F.row_number().over(order).alias("at"), F.xxhash64(F.lit(0), "role", "text").alias("t1"), F.xxhash64(F.lit(1), "role", "text").alias("t2"), F.length("text").alias("chars"))
    own = written(rows.select("conv_id", turn.alias("turn")).groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("own")), "chats")
    heads = own.filter(F.col("conv_id") % HUNDRED == 0).select(F.col("conv_id").alias("base"), F.slice("own", 1, SHARED_TURNS - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED_TURNS).cast("int")
    joined = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % HUNDRED).join(heads, "base", "left")
    turns = F.concat(F.coalesce(F.slice("head", F.lit(1), h), F.slice("own", 1, 0)), F.slice("own", h + 1, F.size("own")))
    return joined.select("conv_id", F.transform(turns, lambda t: t.dropFields("at")).alias("turns"))


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (k1, k2, conv_id) -> for each (k1, k2) the least id, the number of ids and their digest. One hash state is held."""
    now, done, digest = None, [], hashlib.sha256()

    def put() -> None:
        if now is not None:
            done.append((*now, least, n, digest.hexdigest()))

    def batch() -> pa.RecordBatch:
        columns = zip(*done, strict=True) if done else [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["k1", "k2", "conv_id", "n", "ends"])

    least = n = 0
    for b in batches:
        k1, k2, ids = (b.column(c).to_numpy() for c in ("k1", "k2", "conv_id"))
        if not len(ids):
            continue
        cuts = np.flatnonzero((k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])) + 1
        for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)], strict=True):
            key, members = (int(k1[start]), int(k2[start])), ids[start:end].tolist()
            if key != now:
                put()
                now, least, n, digest = key, members[0], 0, hashlib.sha256()
            digest.update(("," * bool(n) + ",".join(map(str, members))).encode())
            n += len(members)
        yield batch()
        done.clear()
    put()
    yield batch()
    give_back()


class DoubleArray:
    """A trie in two arrays: the child of `node` by code c is at BASE[node] + c if CHECK there names `node`. The root is 0, its own CHECK."""

    def __init__(self, room: int):
        self.base, self.check = np.full(room, -1, np.int64), np.full(room, -1, np.int64)
        self.check[0], self._low = 0, 1

    def _grow(self, room: int) -> None:
        if room > len(self.check):
            more = np.full(max(room - len(self.check), len(self.check)), -1, np.int64)
            self.base, self.check = np.concatenate([self.base, more]), np.concatenate([self.check, more])

    def place(self, node: int, codes: np.ndarray) -> np.ndarray:
        """Gives `node` children by these codes, in rising order, at the first base where all their places are free; returns the places."""
        span, at = codes - codes[0], max(self._low, int(codes[0]))
        while True:
            self._grow(at + 256 + int(span[-1]))
            for p in (at + np.flatnonzero(self.check[at : at + 256] < 0)).tolist():
                if len(span) == 1 or (self.check[p + span] < 0).all():
                    self.base[node] = p - codes[0]
                    self.check[p + span] = node
                    while self.check[self._low] >= 0:
                        self._low += 1
                        self._grow(self._low + 1)
                    return p + span
            at += 256

    def step(self, nodes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The children of these nodes by these codes; -1 where there is none."""
        at = self.base[nodes] + codes
        inside = (self.base[nodes] >= 0) & (at < len(self.check))
        return np.where(inside & (self.check[np.where(inside, at, 0)] == nodes) & (at > 0), at, -1)


def packed(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: int) -> DoubleArray:
    """The trie of the sequences codes[start : start + size], built depth by depth."""
    trie = DoubleArray(2 * width + 1024)
    at = np.zeros(len(sizes), np.int64)
    live = np.flatnonzero(sizes > 0)
    for depth in range(int(sizes.max(initial=0))):
        live = live[sizes[live] > depth]
        edges, back = np.unique(at[live] * width + codes[starts[live] + depth], return_inverse=True)
        parents, code = edges // width, edges % width
        cuts = np.flatnonzero(np.diff(parents, prepend=-1))
        places = np.concatenate([trie.place(int(parents[a]), code[a:b]) for a, b in zip(cuts, [*cuts[1:], len(edges)], strict=True)])
        at[live] = places[back]
    return trie


NODES = "key binary, parent_key binary, path array<binary>, conv_id long, depth long, parent_conv_id long, chars long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string"
_ARROW = pa.schema([("key", pa.binary()), ("parent_key", pa.binary()), ("path", pa.list_(pa.binary()))] + [(c, pa.int64()) for c in "conv_id depth parent_conv_id chars n_convs n_children n_leaves saved_tokens".split()] + [("ends", pa.string())])


def shard_nodes(rows: pa.Table) -> pa.Table:
    """Sequences of a shard (conv_id, n, ends, turns, level) -> its nodes. An upper node has a key and only the figures of what is below the upper ones; other nodes' figures are whole."""
    rows = rows.combine_chunks()
    lists = rows.column("turns").combine_chunks() if rows.num_rows else None
    flat, sizes = lists.flatten(), np.diff(lists.offsets.to_numpy())
    starts = np.cumsum(sizes) - sizes
    turns = np.empty(len(flat), [("t1", "<i8"), ("t2", "<i8")])
    turns["t1"], turns["t2"] = flat.field("t1").to_numpy(), flat.field("t2").to_numpy()
    known, codes = np.unique(turns, return_inverse=True)  # dense turn ids
    n, ids, level = (rows.column(c).to_numpy() for c in ("n", "conv_id", "level"))
    trie = packed(codes, starts, sizes, max(len(known), 1))

    room = len(trie.check)
    members, least, depth_of, chars = np.zeros(room, np.int64), np.full(room, np.iinfo(np.int64).max), np.zeros(room, np.int64), np.zeros(room, np.int64)
    upper, ends, by_depth, at = np.zeros(room, bool), {}, [], np.zeros(len(sizes), np.int64)
    live, length = np.arange(len(sizes)), flat.field("chars").to_numpy()
    for depth in range(int(sizes.max(initial=0)) + 1):
        live = live[sizes[live] >= depth]
        if depth:
            at[live] = trie.step(at[live], codes[starts[live] + depth - 1])
            chars[at[live]] = length[starts[live] + depth - 1]
        np.add.at(members, at[live], n[live])
        np.minimum.at(least, at[live], ids[live])
        depth_of[at[live]] = depth
        upper[at[live[depth <= level[live]]]] = True
        by_depth.append(np.unique(at[live]))
        done = live[sizes[live] == depth]
        ends.update(zip(at[done].tolist(), rows.column("ends").take(pa.array(done)).to_pylist(), strict=True))

    nodes = np.concatenate(by_depth)
    below, children = nodes[1:], np.zeros(room, np.int64)
    np.add.at(children, trie.check[below[~upper[below]]], 1)
    leaves, saved = (children == 0).astype(np.int64), (members - 1) * chars
    leaves[upper], saved[upper] = 0, 0
    for level_nodes in by_depth[:0:-1]:
        lower = level_nodes[~upper[level_nodes]]
        np.add.at(leaves, trie.check[lower], leaves[lower])
        np.add.at(saved, trie.check[lower], saved[lower])

    keys, paths = {0: ROOT_KEY}, {0: [ROOT_KEY]}
    for x in below[upper[below]].tolist():
        p = int(trie.check[x])
        keys[x] = hashlib.blake2b(keys[p] + known[x - trie.base[p]].tobytes(), digest_size=16).digest()
        paths[x] = [*paths[p], keys[x]]
    parent = trie.check[nodes]
    out = {
        "key": [keys.get(x) for x in nodes.tolist()],
        "parent_key": [keys.get(p) if x else None for x, p in zip(nodes.tolist(), parent.tolist(), strict=True)],
        "path": [paths.get(x) for x in nodes.tolist()],
        "parent_conv_id": pa.array(least[parent], mask=upper[parent]),
        "ends": [ends.get(x, NO_MEMBER if not upper[x] else "") for x in nodes.tolist()],
    }
    out |= {name: x[nodes] for name, x in (("conv_id", least), ("depth", depth_of), ("chars", chars), ("n_convs", members), ("n_children", children), ("n_leaves", leaves), ("saved_tokens", saved))}
    give_back()
    return pa.table([out[f.name] for f in _ARROW], schema=_ARROW)


def trie_nodes(rows: DataFrame, together: int = TOGETHER, shard: int = SHARD) -> DataFrame:
    """Rows of conversations (conv_id, turn, role, text) -> the nodes of the trie of the rebuilt conversations."""
    turns = F.col("turns")
    keys = [F.xxhash64(F.lit(s), turns["t1"], turns["t2"]).alias(k) for s, k in enumerate(("k1", "k2"))]
    chats = written(rebuilt(rows).select("conv_id", "turns", *keys), "rebuilt")
    ends = written(chats.select("k1", "k2", "conv_id").repartition("k1", "k2").sortWithinPartitions("k1", "k2", "conv_id").mapInArrow(_ends, "k1 long, k2 long, conv_id long, n long, ends string"), "ends")
    sequences = chats.drop("k1", "k2").join(ends.select("conv_id", "n", "ends"), "conv_id")

    powers = F.array(*[F.lit(1 << k) for k in range(1, 31)])
    levels = F.filter(powers, lambda p: p <= 2 * F.greatest(F.size("turns"), F.lit(1)))  # at the last one the prefix is the whole sequence
    prefix = [F.xxhash64(F.lit(s), F.slice(turns["t1"], F.lit(1), F.col("level")), F.slice(turns["t2"], F.lit(1), F.col("level"))).alias(p) for s, p in enumerate(("p1", "p2"))]
    prefixes = sequences.select("conv_id", "turns", F.explode(levels).alias("level")).select("conv_id", "level", *prefix)
    crowded = prefixes.groupBy("level", "p1", "p2").agg(F.count(F.lit(1)).alias("of")).filter(F.col("of") > together).drop("of")
    cut = prefixes.join(crowded, ["level", "p1", "p2"], "left_anti").groupBy("conv_id").agg(F.min(F.struct("level", "p1", "p2")).alias("cut"))
    shards = max(1, -(-ends.count() // shard))
    dealt = sequences.join(cut, "conv_id").select(F.pmod("cut.p1", F.lit(shards)).alias("shard"), "conv_id", "n", "ends", "turns", F.col("cut.level").cast("long").alias("level"))
    nodes = written(dealt.groupBy("shard").applyInArrow(shard_nodes, NODES), "trie-nodes")

    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    upper = nodes.filter("key is not null").groupBy("key").agg(*[F.max(c).alias(c) for c in ("parent_key", "path", "depth", "chars", "ends")], F.min("conv_id").alias("conv_id"), *sums)
    upper = written(upper, "upper-nodes")
    known = upper.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent"))
    beneath = upper.filter("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(F.count(F.lit(1)).alias("more"))
    upper = upper.join(beneath, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0)))
    own_leaf, own_saved = (F.col("n_children") == 0).cast("long"), (F.col("n_convs") - 1) * F.col("chars")
    along = upper.select(F.explode("path").alias("key"), (own_leaf + F.col("n_leaves")).alias("leaves"), (own_saved + F.col("saved_tokens")).alias("saved"))
    along = along.groupBy("key").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    upper = upper.drop("n_leaves", "saved_tokens", "more").join(along, "key").join(known, "parent_key", "left")
    lower = nodes.filter("key is null")
    first = lower.filter("parent_key is not null").join(known, "parent_key")
    columns = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    parts = [
        upper.select(*columns, F.col("parent").alias("parent_conv_id"), F.when(F.col("ends") == "", NO_MEMBER).otherwise(F.col("ends")).alias("ends_sha256")),
        first.select(*columns, F.col("parent").alias("parent_conv_id"), F.col("ends").alias("ends_sha256")),
        lower.filter("parent_key is null").select(*columns, "parent_conv_id", F.col("ends").alias("ends_sha256")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def query(spark, sf_dir: str) -> DataFrame:
    return trie_nodes(table(spark, sf_dir, "conversations"))


SQL = r"""
with bytes as (
  select i, list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as crc from range(256) t(i)
), crcs as materialized (
  select list(crc order by i) as crcs from bytes
), convs as (
  select distinct conv_id as c, conv_id - conv_id % 100 as base,
    xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint)),
      lambda crc, b: xor(crc >> 8, crcs[(xor(crc, b) & 255) + 1])), 4294967295::bigint) % 6 as h
  from conversations, crcs where conv_id is not null
), turns as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as place
  from conversations where conv_id is not null
), rebuilt as (
  select c, place, role, text from convs join turns on conv_id = c where place > h
  union all select c, place, role, text from convs join turns on conv_id = base where place <= h
), placed as (
  select c, sha256(role) || sha256(text) as turn, length(text) as chars, row_number() over (partition by c order by place) as depth from rebuilt
), prefixes as (
  select c, depth, chars, sha256(string_agg(turn, '') over (partition by c order by depth)) as node from placed
  union all select c, 0, 0, '' from convs
), sizes as (
  select c, max(depth) as size from prefixes group by c
), nodes as (
  select node, depth, min(c) as conv_id, count(*) as n_convs, max(chars) as chars,
    sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (where size = depth), '')) as ends_sha256
  from prefixes join sizes using (c) group by node, depth
), edges as (
  select n.node, p.node as parent, q.conv_id as parent_conv_id from nodes n join prefixes p on p.c = n.conv_id and p.depth = n.depth - 1 join nodes q on q.node = p.node
), kids as (
  select parent as node, count(*) as n from edges group by parent
), own as (
  select nodes.*, coalesce(kids.n, 0) as n_children, (n_convs - 1) * chars as saved from nodes left join kids using (node)
), below as (
  select p.node, sum(case when n_children = 0 then 1 else 0 end) as n_leaves, sum(saved) as saved_tokens
  from own o join prefixes p on p.c = o.conv_id and p.depth <= o.depth group by p.node
)
select conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves::bigint as n_leaves, saved_tokens::bigint as saved_tokens, ends_sha256
from own join below using (node) left join edges using (node)
"""
