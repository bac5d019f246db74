"""The trie of conversations that share their first turns, from sorted conversations and sparse tables.

Conversations are sorted by their turns and dealt out in that order as blocks. Beside each other they share so many first
turns, their LCP. A prefix that two neighbours share is a candidate; its members are the neighbours on both sides as far as
no LCP falls below its depth. A sparse table answers the least LCP of any stretch in two looks, so each candidate finds the
left and right end of its members by binary search, all candidates at once and none with a stack. Sums over a subtree are
then differences of running sums over the sorted conversations.

A prefix may go on in the next block. All that is told of a node adds up, so each block tells its part of the prefixes that
it shares with its neighbours, and the parts are put together; a prefix of a third of all conversations is one row a block.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.llm.common import Batches, durable

TURN = 16  # bytes that stand for a turn
BLOCK_TURNS = 1 << 17
NO_ENDS = hashlib.sha256(b"").hexdigest()


def rebuilt_conversations(turns: DataFrame, family: int = 5, heads: int = 9) -> DataFrame:
    """turns(conv_id, turn, role, text) -> conv_id, key (TURN bytes per turn), sizes (UTF-8 bytes of each turn's text).

    Turns stand in order of turn, null first, ties by the digest of role and text; null role or text is empty. Conversation c
    gets the first h turns of c - c % family, all if fewer and none if there is no such conversation, then its own turns after
    its first h; h = crc32(decimal c) % heads. Rows with a null conv_id are left out. Only digests and sizes are shuffled.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    item = F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("size"))
    base = F.col("conv_id") - F.col("conv_id") % family
    rows = turns.where("conv_id is not null").select(base.alias("base"), "conv_id", item.alias("item")).repartition("base")
    own = rows.groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("item")).alias("own"))
    head = F.max(F.when(F.col("conv_id") == F.col("base"), F.slice("own", 1, heads - 1))).over(W.partitionBy("base"))
    both = own.select("conv_id", "own", F.coalesce(head, F.slice("own", 1, 0)).alias("head"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int").alias("h"))
    whole = F.concat(F.slice("head", F.lit(1), F.col("h")), F.slice("own", F.col("h") + 1, F.greatest(F.size("own") - F.col("h"), F.lit(0))))
    done = both.select("conv_id", whole.alias("turns"))
    return done.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), "")).alias("key"), F.transform("turns", lambda t: t["size"]).alias("sizes"))


def common_turns(keys: list[bytes]) -> np.ndarray:
    """Turns that each key shares with the one before; the first shares none."""
    n = len(keys)
    size = np.array([len(k) // TURN for k in keys], np.int64)
    flat = np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2) if size.sum() else np.zeros((0, 2), "<u8")
    at = np.r_[0, np.cumsum(size)[:-1]] if n else size
    out, live, depth = np.zeros(n, np.int64), np.arange(1, n), 0
    while len(live):
        live = live[np.minimum(size[live], size[live - 1]) > depth]
        live = live[(flat[at[live] + depth] == flat[at[live - 1] + depth]).all(1)]
        depth += 1
        out[live] = depth
    return out


class SparseMinimum:
    """Least value of any stretch in two looks."""

    def __init__(self, values: np.ndarray):
        self.rows = [np.asarray(values, np.int64)]
        while 2 << (len(self.rows) - 1) <= len(values):
            step = 1 << (len(self.rows) - 1)
            self.rows.append(np.minimum(self.rows[-1][:-step], self.rows[-1][step:]))

    def least(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of values a..b, both inclusive, a <= b."""
        level = np.frexp(b - a + 1.0)[1] - 1
        out = np.zeros(len(a), np.int64)
        for k in np.unique(level):
            i = level == k
            out[i] = np.minimum(self.rows[k][a[i]], self.rows[k][b[i] - (1 << k) + 1])
        return out

    def reach(self, at: np.ndarray, depth: np.ndarray, right: bool) -> np.ndarray:
        """How far one can go from each place so that no value on the way is below depth: the last such place. The value at
        the place itself is not looked at. values[i] stands between place i - 1 and place i."""
        n = len(self.rows[0])
        low, high = np.zeros(len(at), np.int64), (n - 1 - at if right else at.copy())  # steps: low are sure, none over high
        while (low < high).any():
            middle = (low + high + 1) // 2
            go = np.zeros(len(at), bool)
            i = np.flatnonzero(low < high)
            a, b = (at[i] + 1, at[i] + middle[i]) if right else (at[i] - middle[i] + 1, at[i])
            go[i] = self.least(a, b) >= depth[i]
            low, high = np.where(go, middle, low), np.where(go | (low == high), high, middle - 1)
        return at + low if right else at - low


def block_nodes(conv: np.ndarray, keys: list[bytes], sizes: list[np.ndarray], before: int, after: int) -> dict[str, np.ndarray]:
    """Every prefix of a block of sorted conversations, told as far as this block goes.

    before, after: turns shared with the last conversation of the block before and the first of the one after, -1 without
    one. left, right: first and last member; open: whether members go on in another block; parent: place of the parent's row.
    """
    n = len(conv)
    length = np.array([len(s) for s in sizes], np.int64)
    start = np.r_[0, np.cumsum(length + 1)]  # of each conversation's running sizes, from 0
    run = np.concatenate([np.r_[0, np.cumsum(s)] for s in sizes])
    total = run[start[1:] - 1]
    lcp = common_turns(keys)
    table = SparseMinimum(np.r_[-1, lcp[1:]])
    # prefixes that two neighbours share: the deepest of each set of members, found from any pair inside
    pair = np.arange(1, n)
    left, right = table.reach(pair, lcp[1:], False), table.reach(pair, lcp[1:], True)
    group = np.unique(np.stack([left, right, lcp[1:]], 1), axis=0) if n > 1 else np.zeros((0, 3), np.int64)
    # prefixes of one member
    near = np.maximum(np.r_[-1, lcp[1:]], np.r_[lcp[1:], -1])
    single = np.flatnonzero(length > near)
    l, r, deep = (np.r_[a, b] for a, b in zip(group.T, (single, single, length[single])))
    outside = np.maximum(np.r_[-1, lcp[1:]][l], np.r_[lcp[1:], -1][r])
    many = deep - outside  # depths outside + 1 .. deep have these members
    node = np.repeat(np.arange(len(l)), many)
    depth = deep[node] - (np.repeat(np.cumsum(many), many) - 1 - np.arange(len(node)))
    left, right = l[node], r[node]
    order = np.lexsort((depth, left))
    left, right, depth = left[order], right[order], depth[order]
    code = left * (length.max(initial=0) + 2) + depth
    up = table.reach(left, depth - 1, False)
    parent = np.where(depth > 0, np.searchsorted(code, up * (length.max(initial=0) + 2) + depth - 1), -1)
    lcp[0] = before
    ahead = np.r_[lcp[1:], after]
    fresh = np.maximum(lcp, 0)
    sums = lambda x: np.r_[0, np.cumsum(x)]
    at = lambda i, d: run[start[i] + d]
    leaf, whole, own = sums(ahead < length), sums(total), sums(total - at(np.arange(n), fresh))
    members, above = right - left + 1, np.maximum(depth - 1, 0)
    said = whole[right + 1] - whole[left] - members * at(left, above)  # every member's turns from this depth on
    once = own[right + 1] - own[left + 1] + total[left] - at(left, np.maximum(fresh[left], above))  # each distinct turn once
    new = (lcp[left] < depth) & (depth > 0)  # the prefix begins in this block
    lowest = SparseMinimum(conv).least(left, right)
    ends = np.searchsorted(code, np.arange(n) * (length.max(initial=0) + 2) + length)  # conversations that begin a run of equal ones
    first = np.r_[True, (lcp[1:] < length[1:]) | (length[1:] != length[:-1])]
    runs = np.flatnonzero(first)
    return {
        "left": left, "right": right, "depth": depth, "parent": parent, "conv_id": lowest, "n_convs": members,
        "n_children": np.bincount(parent[new], minlength=len(left)), "n_leaves": leaf[right + 1] - leaf[left], "saved_tokens": said - once,
        "open": ((left == 0) & (depth <= before)) | ((right == n - 1) & (depth <= after)),
        "end_of": ends[runs], "end_from": runs, "end_to": np.r_[runs[1:], n],
    }


NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
PARTS = f"{NODES}, ends binary, block long, prefix binary, up binary"


def _prefixes(key: bytes, depths: int) -> list[bytes]:
    """A digest of each prefix of a key, depth 0 to depths."""
    h = hashlib.md5()
    out = [h.digest()]
    for d in range(depths):
        h.update(key[d * TURN : d * TURN + TURN])
        out.append(h.digest())
    return out


def _told(block: int, conv: np.ndarray, keys: list[bytes], sizes: list[np.ndarray], before: int, after: int) -> pa.RecordBatch:
    t = block_nodes(conv, keys, sizes, before, after)
    n = len(t["left"])
    listed = [",".join(map(str, conv[a:b].tolist())).encode() for a, b in zip(t["end_from"], t["end_to"])]
    ends, digests = [b""] * n, [NO_ENDS] * n
    is_open, parent = t["open"], t["parent"]
    for at, x in zip(t["end_of"].tolist(), listed):
        if is_open[at]:
            ends[at] = x
        else:
            digests[at] = hashlib.sha256(x).hexdigest()
    prefix, up = [None] * n, [None] * n
    known = _prefixes(keys[0], max(0, before)), _prefixes(keys[-1], max(0, after))
    for at in np.flatnonzero(is_open).tolist():
        side = 0 if t["left"][at] == 0 and t["depth"][at] <= before else 1
        prefix[at] = known[side][t["depth"][at]]
    for at in np.flatnonzero((parent >= 0) & is_open[parent]).tolist():
        up[at] = prefix[parent[at]]
    closed_up = (parent >= 0) & ~is_open[parent]
    parents = pa.array(np.where(closed_up, t["conv_id"][parent], 0), mask=~closed_up)
    columns = [pa.array(t["conv_id"]), pa.array(t["depth"]), parents, *(pa.array(t[c].astype(np.int64)) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"))]
    columns += [pa.array(digests), pa.array(ends, pa.binary()), pa.array(np.full(n, block)), pa.array(prefix, pa.binary()), pa.array(up, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "ends", "block", "prefix", "up"])


def _one_table(batches: Batches) -> pa.Table | None:
    held = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(held) if held else None


def _edges(batches: Batches) -> Batches:
    """The first and last key of a block."""
    first = last = block = None
    for b in batches:
        if b.num_rows:
            first = b.column(1)[0].as_py() if first is None else first
            last, block = b.column(1)[b.num_rows - 1].as_py(), b.column(0)[0].as_py()
    if block is not None:
        yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([first], pa.binary()), pa.array([last], pa.binary())], names=["block", "first", "last"])


def _shared(batches: Batches) -> Batches:
    for b in batches:
        both = zip(b.column(1).to_pylist(), b.column(2).to_pylist())
        n = [-1 if x is None or y is None else int(common_turns([x, y])[1]) for x, y in both]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["block", "n"])


def _joined(batches: Batches) -> Batches:
    """Parts of one prefix, in order of blocks, become its node; the list of ends is hashed as it goes by."""
    names = ["n_convs", "n_children", "n_leaves", "saved_tokens"]

    def node(now: dict) -> pa.RecordBatch:
        values = [now["prefix"], now["up"], now["depth"], now["conv_id"], *(now[c] for c in names), now["sha"].hexdigest()]
        return pa.RecordBatch.from_pylist([dict(zip(JOINED.names, values))], JOINED)

    now = None
    for b in batches:
        for row in b.to_pylist():
            if now is None or now["prefix"] != row["prefix"]:
                if now is not None:
                    yield node(now)
                now = row | {"sha": hashlib.sha256(row["ends"]), "some": bool(row["ends"])}
                continue
            now["conv_id"] = min(now["conv_id"], row["conv_id"])
            for c in names:
                now[c] += row[c]
            if row["ends"]:
                now["sha"].update((b"," if now["some"] else b"") + row["ends"])
                now["some"] = True
    if now is not None:
        yield node(now)


JOINED = pa.schema([("prefix", pa.binary()), ("up", pa.binary()), ("depth", pa.int64()), ("conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string())])


def prefix_trie(turns: DataFrame, family: int = 5, heads: int = 9, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """turns(conv_id, turn, role, text) -> a row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256, of the rebuilt conversations' trie (see rebuilt_conversations for order, nulls and ties).

    conv_id is the smallest member, n_convs counts the members, saved_tokens adds up, over the subtree, (n_convs - 1) times
    the bytes of a node's last text, ends_sha256 is that of the members that end here, in ascending order, comma-joined.
    Repeated rows are turns of their own. A conversation left without turns is a member of the root alone; without any
    conversation there is no node. Other columns are ignored.

    Blocks are ranges of the order (turns, then conv_id), so equal conversations spread over blocks like different ones. A
    conversation is one row of 24 bytes a turn, and a block some block_turns turns. Of a prefix that goes on in other blocks
    each block tells one row. The sorted rows are checkpointed: a lost executor costs its own blocks only.
    """
    spark = turns.sparkSession
    convs = durable(rebuilt_conversations(turns, family, heads))
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    n = convs.agg(F.sum(F.size("sizes") + 1)).first()[0] or 0
    blocks = max(int(parts), -(-n // block_turns))
    ordered = convs.repartitionByRange(blocks, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    ordered = durable(ordered.withColumn("block", F.spark_partition_id().cast("long")))
    edges = durable(ordered.select("block", "key").mapInArrow(_edges, "block long, first binary, last binary"))
    one = W.orderBy("block")  # one row per block
    with_last = edges.select("block", F.lag("last").over(one).alias("last"), "first")
    before = durable(with_last.mapInArrow(_shared, "block long, n long"))
    sides = before.select("block", F.col("n").alias("before"), F.coalesce(F.lead("n").over(one), F.lit(-1).cast("long")).alias("after"))  # three numbers per block

    def tell(batches: Batches) -> Batches:
        t = _one_table(batches)
        if t is not None:
            sizes = t.column("sizes").combine_chunks()
            at = sizes.offsets.to_numpy()
            flat = sizes.values.to_numpy(zero_copy_only=False)
            rows = [flat[a:b] for a, b in zip(at[:-1], at[1:])]
            first = lambda c: t.column(c)[0].as_py()
            yield _told(first("block"), t.column("conv_id").to_numpy(), t.column("key").to_pylist(), rows, first("before"), first("after"))

    told = durable(ordered.join(F.broadcast(sides), "block").select("conv_id", "key", "sizes", "block", "before", "after").mapInArrow(tell, PARTS))
    names = [x.split()[0] for x in NODES.split(", ")]
    pieces = told.where("prefix is not null").select("prefix", "up", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends", "block")
    schema = "prefix binary, up binary, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
    nodes = durable(pieces.repartition("prefix").sortWithinPartitions("prefix", "block").mapInArrow(_joined, schema))
    names_of = nodes.select(F.col("prefix").alias("of"), F.col("conv_id").alias("whose"))
    shared = nodes.join(names_of, F.col("up") == F.col("of"), "left").select(*[F.col("whose").alias(c) if c == "parent_conv_id" else F.col(c) for c in names])
    here = told.where("prefix is not null").select("block", "prefix").join(names_of, F.col("prefix") == F.col("of")).select(F.col("block").alias("b"), "of", "whose")
    single = told.where("prefix is null")
    below = single.where("up is not null").join(here, (F.col("block") == F.col("b")) & (F.col("up") == F.col("of"))).select(*[F.col("whose").alias(c) if c == "parent_conv_id" else F.col(c) for c in names])
    return single.where("up is null").select(*names).union(below).union(shared)


ORACLE = """
with b as (select conv_id c, row_number() over (partition by conv_id order by turn nulls first, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) k, coalesce(role, '') r, coalesce(text, '') t from conversations where conv_id is not null),
crc as (select c, xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(c::varchar, ''), lambda x: [ascii(x)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, x: case when x >= 0 then xor(a, x) when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end), 4294967295) % 9 h from (select distinct c from b)),
re as (select crc.c, k, r, t from crc join b on b.c = crc.c - crc.c % 5 and k <= h union all select crc.c, k, r, t from crc join b on b.c = crc.c and k > h),
p as (select c, row_number() over w d, strlen(t) bytes, string_agg(md5(strlen(r) || ':' || r || t), '') over w path from re window w as (partition by c order by k)),
pc as (select c, 0 d, 0 bytes, '' path from crc union all select * from p),
n as (select path, d, min(c) conv_id, count(*) n_convs, any_value(bytes) bytes from pc group by path, d),
l as (select c, max(d) d, arg_max(path, d) path from pc group by c),
e as (select path, string_agg(c::varchar, ',' order by c) ends from l group by path),
ch as (select substr(path, 1, 32 * (d - 1)::int) up, count(*) n_children from n where d > 0 group by 1),
s as (select v.path, count(*) filter (where ch.up is null) n_leaves, sum((u.n_convs - 1) * u.bytes) saved from n v join n u on starts_with(u.path, v.path) left join ch on ch.up = u.path group by v.path)
select n.conv_id, n.d depth, pa.conv_id parent_conv_id, n.n_convs, coalesce(ch.n_children, 0) n_children, s.n_leaves, cast(s.saved as bigint) saved_tokens, sha256(coalesce(e.ends, '')) ends_sha256
from n join s on s.path = n.path left join ch on ch.up = n.path left join e on e.path = n.path left join n pa on n.d > 0 and pa.path = substr(n.path, 1, 32 * (n.d - 1)::int)"""
