"""SimHash fingerprints and their near-duplicate groups by multi-index hashing.

A fingerprint is cut into segments, each with a table from segment value to fingerprints. If two fingerprints differ in
at most r of 64 bits, then in some segment they differ in few: each fingerprint enumerates the small Hamming ball round
each of its segments, fetches the matching table rows and verifies the full distance. A table row with more than
``cap`` fingerprints is never paired out: all that reach it go through midpoints instead (two fingerprints at distance
r or less share a point within r // 2 of one and r - r // 2 of the other), linked as stars, which is exact as well.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import Batches, connected_components, durable, in_parts, release, runs_of
from granary.llm.suffix_dedup import _batch, _col, _keyed_runs

SEED = 42
CAP = 64
_CHUNK = 1 << 15
_TOGETHER = 256  # texts whose bits are counted together


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of word shingles, repeats counted; zero for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    n = max(1, len(words) - shingle + 1)
    digest, count = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        to = min(n, at + _CHUNK)
        spans = zip(starts[at:to].tolist(), ends[min(shingle, len(words)) - 1 :][at:to].tolist())
        h = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, to - at)
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(count * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """docs(doc_id, text) -> doc_id, fp long. Null and empty texts have fingerprint zero."""

    def run(batches: Batches) -> Batches:
        for rows in in_parts(batches):
            fps = [fingerprint(t, shingle) for t in rows.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def _ball(width: int, radius: int) -> list[int]:
    return [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _each(values: list[int]) -> Column:
    return F.explode(F.array(*[F.lit(_signed(v)).cast("long") for v in values]))


def similar_fingerprints(fps: DataFrame, radius: int = 2, segments: int = 2, cap: int = CAP) -> DataFrame:
    """Distinct fps(fp) -> links (src, dst), enough to connect what lies within ``radius`` bits, none beyond it."""
    if 64 % segments:
        raise ValueError("segments must divide 64")
    width = 64 // segments
    each, sharp = radius // segments, radius % segments
    mask = (1 << width) - 1
    tables, probes = [], []
    for t in range(segments):
        key = F.shiftrightunsigned("fp", t * width).bitwiseAND(F.lit(_signed(mask)).cast("long"))
        tables.append(fps.select(F.lit(t).alias("t"), key.alias("key"), "fp"))
        # pigeonhole: with sharp = radius mod segments, the first sharp + 1 segments need the larger ball
        r = each if t <= sharp else each - 1
        if r >= 0:
            probes.append(fps.select("fp", key.alias("own"), _each(_ball(width, r)).alias("m")).select(F.lit(t).alias("t"), F.col("own").bitwiseXOR(F.col("m")).alias("key"), "fp"))
    table = tables[0]
    for x in tables[1:]:
        table = table.union(x)
    probe = probes[0]
    for x in probes[1:]:
        probe = probe.union(x)
    sizes = table.groupBy("t", "key").agg(F.count("*").alias("n"))
    small = table.join(sizes.where(F.col("n") <= cap), ["t", "key"]).groupBy("t", "key").agg(F.collect_list("fp").alias("fps"))
    rows = small.union(sizes.where(F.col("n") > cap).select("t", "key", F.lit(None).cast("array<long>")))
    met = durable(probe.join(rows, ["t", "key"]).select("fp", "fps").where("fps is null or size(fps) > 1 or fps[0] <> fp"))
    pairs = met.where("fps is not null").select("fp", F.explode("fps").alias("other"))
    pairs = pairs.where((F.col("fp") != F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= radius))
    links = pairs.select(F.least("fp", "other").alias("src"), F.greatest("fp", "other").alias("dst")).distinct()
    dense = durable(met.where("fps is null").select("fp").distinct())
    if dense.isEmpty():
        return links
    near, far = radius // 2, radius - radius // 2
    points = dense.select("fp", _each(_ball(64, far)).alias("m")).select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("z"), (F.bit_count("m") <= near).alias("close"))
    hub = points.groupBy("z").agg(F.min(F.when(F.col("close"), F.col("fp"))).alias("hub"), F.count("*").alias("n")).where("hub is not null and n > 1")
    star = points.join(hub, "z").where("fp <> hub").select(F.col("hub").alias("src"), F.col("fp").alias("dst")).distinct()
    return links.union(star)


def simhash_groups(docs: DataFrame, shingle: int = 3, radius: int = 2, segments: int = 2, cap: int = CAP) -> DataFrame:
    """docs(doc_id, text) -> doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links).

    Equal fingerprints link as well; texts without words, nulls among them, have fingerprint zero and link like any
    other. A null doc_id takes part but is never a component_id unless the whole component has none. Repeated rows give
    repeated rows. Other columns are ignored. An empty table gives an empty result.
    """
    rows = durable(fingerprints(docs, shingle))
    first = durable(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    comp = connected_components(similar_fingerprints(first.select("fp"), radius, segments, cap))
    led = first.join(comp, first.fp == comp.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("c"))
    low = led.groupBy("c").agg(F.min("first").alias("component_id"))
    named = led.join(low, "c").select(F.col("fp").alias("of"), "component_id")
    return rows.join(named, rows.fp == named.of, "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


WIDE_WORDS = 16
WIDE_BITS = 64 * WIDE_WORDS
KEYS, KEY_BITS = 192, 24
MAX_BITS = 180
SIMILAR = 0.8
GROUP = 1 << 18
BLOCK_BYTES = 4 << 20
FEW = 16
SMALL = 256  # texts of so many distinct shingles or fewer meet by shingles, not by bits
SMALL_BITS = 290
COUNTS = 1 << 18
_PICKS = np.array([np.random.default_rng(SEED + k).choice(WIDE_BITS, KEY_BITS, replace=False) for k in range(KEYS)])
_MIX = np.random.default_rng(SEED).integers(1 << 62, (1 << 63) - 1, WIDE_WORDS - 1).astype(np.uint64) | np.uint64(1)


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Hashes of a text's distinct word shingles, in order; empty without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    n = max(1, len(words) - shingle + 1)
    spans = zip(starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist())
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans), np.uint64, n))


def _bit_sums(level: np.ndarray) -> np.ndarray:
    """How many of level[:, doc] have each bit set: carry-save sums of three words at a time, unpacked at the end."""
    _, docs, width = level.shape
    sums, weight = np.zeros((docs, 64 * width), np.int32), 1
    while len(level):
        carries = []
        while len(level) >= 3:
            m = len(level) // 3
            a, b, c = level[:m], level[m : 2 * m], level[2 * m : 3 * m]
            odd = a ^ b
            carries.append((a & b) | (odd & c))
            level = np.concatenate([odd ^ c, level[3 * m :]])
        for words in level:
            sums += weight * np.unpackbits(words.view(np.uint8), axis=1, bitorder="little").astype(np.int32)
        level, weight = np.concatenate(carries) if carries else level[:0], weight * 2
    return sums


def wide_fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """1024-bit SimHashes of shingle sets, 16 words each: every hash is mixed into 16 words; zeros for an empty set."""
    out = np.zeros((len(sets), WIDE_WORDS), np.uint64)
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    while order:
        group = [order.pop()]
        longest = len(sets[group[0]])
        if not longest:
            break
        while order and len(group) < _TOGETHER and (len(group) + 1) * longest <= _CHUNK and 2 * len(sets[order[-1]]) >= longest:
            group.append(order.pop())
        sums = np.zeros((len(group), WIDE_BITS), np.int64)
        for at in range(0, longest, _CHUNK):
            parts = [sets[i][at : at + _CHUNK] for i in group]
            sizes = np.array([len(x) for x in parts])
            h = np.concatenate(parts)[:, None]
            more = (h ^ (h >> np.uint64(31))) * _MIX
            more = (more ^ (more >> np.uint64(29))) * _MIX[0]
            padded = np.zeros((int(sizes.max()), len(group), WIDE_WORDS), np.uint64)
            row = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            padded[row, np.repeat(np.arange(len(group)), sizes)] = np.hstack([h, more ^ (more >> np.uint64(32))])
            sums += _bit_sums(padded)
        total = np.array([len(sets[i]) for i in group])
        out[group] = np.packbits(sums * 2 > total[:, None], axis=1, bitorder="little").view(np.uint64)
    return out


def _words(column) -> np.ndarray:
    """A column of binary fingerprints as rows of words."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, WIDE_WORDS)


def _fixed(rows: np.ndarray) -> pa.Array:
    """Rows of equal width as a binary column."""
    width = rows.dtype.itemsize * rows.shape[1]
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.binary())


def _sampled_keys(batches: Batches) -> Batches:
    """(id, fp) -> (id, key): KEYS keys a fingerprint, each the number of a sample and its KEY_BITS bits."""
    numbers = np.arange(KEYS) << KEY_BITS
    for whole in batches:
        for at in range(0, whole.num_rows, 2048):
            rows = whole.slice(at, 2048)
            bits = np.unpackbits(_words(rows.column(1)).view(np.uint8), axis=1, bitorder="little")
            packed = np.packbits(bits[:, _PICKS.ravel()].reshape(-1, KEYS, KEY_BITS), axis=2).astype(np.int64)
            keys = numbers + (packed[:, :, 0] | packed[:, :, 1] << 8 | packed[:, :, 2] << 16)
            ids = np.repeat(rows.column(0).to_numpy(zero_copy_only=False), KEYS)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(keys.ravel())], names=["id", "key"])


def _prefix_keys(hashes: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The rarest shingles of a set, so many that two sets of SIMILAR share one at least.

    level: how common each bucket of shingles is. Any order of shingles that all sets agree on will do; this one puts what
    very many texts hold, such as a common passage, last.
    """
    rank = np.lexsort((hashes, level[hashes % np.uint64(COUNTS)]))
    return hashes[rank[: len(hashes) - int(np.ceil(SIMILAR * len(hashes) - 1e-9)) + 1]]


def _shingle_levels(docs: DataFrame, shingle: int) -> np.ndarray:
    """The logarithm of how many texts of SMALL shingles or fewer hold one of each bucket: one pass, COUNTS numbers a task."""

    def run(batches: Batches) -> Batches:
        count = np.zeros(COUNTS, np.int64)
        for rows in in_parts(batches):
            for t in rows.column(0).to_pylist():
                if t and len(t) < 1 << 17:
                    h = shingle_set(t, shingle)
                    if len(h) * SIMILAR <= SMALL:
                        np.add.at(count, (h % np.uint64(COUNTS)).astype(np.int64), 1)
        held = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(count[held])], names=["bucket", "n"])

    counts = docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    level = np.zeros(COUNTS, np.uint8)
    level[counts["bucket"].to_numpy(np.int64)] = np.log2(counts["n"].to_numpy(float)).astype(np.uint8)
    return level


def _unpacked(batches: Batches) -> Batches:
    """(id, keys) -> (id, key)"""
    for rows in batches:
        keys = [np.frombuffer(x, np.int64) for x in rows.column(1).to_pylist()]
        ids = np.repeat(rows.column(0).to_numpy(zero_copy_only=False), [len(x) for x in keys])
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate([np.zeros(0, np.int64), *keys]))], names=["id", "key"])


def _near(first: DataFrame, keyed: DataFrame, max_bits: int, group: int) -> tuple[DataFrame, DataFrame]:
    """(links between those of first(id, fp) that share a key and differ in max_bits or fewer, what to release after them)"""
    met = durable(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_shared_keys, "id long, key long"))
    dealt = _in_parts_of(met, met.groupBy("key").agg(F.ceil(F.count("*") / group).cast("int").alias("m")).where("m > 1"))
    near = dealt.join(first.select("id", "fp"), "id").select("id", "g", "fp").repartition("g").sortWithinPartitions("g", "id")
    return near.mapInArrow(_reached(max_bits), "src long, dst long"), met


def near_duplicate_groups(docs: DataFrame, shingle: int = 5, max_bits: int = MAX_BITS, group: int = GROUP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs(doc_id, text) -> doc_id, text_hash, component_id, kept: groups linked by a word-shingle Jaccard of 0.8 or more.

    Texts of equal shingle sets are one node. Bits propose: 0.8 is some 15 % differing bits of 1024, and nodes that agree in
    one of 192 samples of 24 bits and differ in at most max_bits belong to one cluster. Of sets of SMALL shingles or fewer the
    bits vary more, so these meet where they share one of their rarest shingles, which no two similar ones fail to do, and
    may differ in SMALL_BITS: two sets of 0.8 differ in some 200 bits, with a deviation of 13, however small. Under a key each node is
    told once, by the first that reaches it, so a key of n nodes gives n rows and no pairs. The shingle sets of a cluster
    then meet once, and every pair in it that is similar by the sets themselves links; again only what joins two parts is told.
    A key of more than ``group`` nodes and a cluster of more than ``block_bytes`` of sets are met in parts, each with each.

    component_id: smallest doc_id of the group; kept: whether (doc_id, text_hash) is the group's smallest. Texts without
    words, nulls among them, and rows with a null doc_id link with nothing and are kept. Rows of one doc_id with different
    texts are judged each by its text; repeated rows come out repeated. An empty table gives an empty result.
    """
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    level = _shingle_levels(docs, shingle)

    def run(batches: Batches) -> Batches:
        for rows in in_parts(batches):
            sets = [shingle_set(t, shingle) for t in rows.column(1).to_pylist()]
            same = pa.array([xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets], pa.binary())
            small = [_prefix_keys(x, level).tobytes() if 0 < len(x) * SIMILAR <= SMALL else None for x in sets]
            sizes = pa.array([len(x) for x in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), same, sizes, _fixed(wide_fingerprints(sets)), pa.array(small, pa.binary())], names=["doc_id", "th", "same", "n", "fp", "keys"])

    def sets_of(batches: Batches) -> Batches:
        for rows in in_parts(batches):
            sets = pa.array([shingle_set(t, shingle).tobytes() for t in rows.column(0).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*rows.columns[1:], sets], names=["id", "c", "m", "hs"])

    rows = durable(hashed.mapInArrow(run, "doc_id long, th long, same binary, n long, fp binary, keys binary"))
    live = rows.where("doc_id is not null and same is not null")
    first = live.groupBy("same").agg(F.min(F.struct("doc_id", "th")).alias("x"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys"))
    first = durable(first.select(F.monotonically_increasing_id().alias("id"), "same", F.col("x.doc_id").alias("low"), F.col("x.th").alias("th"), "n", "fp", "keys"))
    by_bits = first.where(F.col("n") > SMALL).select("id", "fp").mapInArrow(_sampled_keys, "id long, key long")
    by_shingles = first.where("keys is not null").select("id", "keys").mapInArrow(_unpacked, "id long, key long")
    near, met = zip(_near(first, by_bits, max_bits, group), _near(first, by_shingles, SMALL_BITS, group))
    cluster = connected_components(near[0].union(near[1]))
    release(*met)
    members = cluster.join(first.select("id", "n", "low", F.col("th").alias("of")), F.col("node") == F.col("id"))
    sizes = members.groupBy(F.col("component").alias("c")).agg(F.ceil(F.sum(8 * F.col("n")) / block_bytes).cast("int").alias("m"))
    wanted = members.join(sizes, F.col("component") == F.col("c")).select("id", "low", "of", "c", "m")
    texts = hashed.join(wanted, (hashed.doc_id == wanted.low) & (hashed.th == wanted.of)).dropDuplicates(["doc_id", "th"]).select("text", "id", "c", "m")
    sets = texts.mapInArrow(sets_of, "id long, c long, m int, hs binary").withColumn("s", F.pmod(F.xxhash64("id"), "m").cast("int"))
    sets = sets.select("id", "hs", "c", "s", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("x"))
    sets = sets.select(F.xxhash64("c", F.least("s", "x"), F.greatest("s", "x")).alias("g"), "id", "s", "hs")
    final = connected_components(sets.repartition("g").sortWithinPartitions("g").mapInArrow(_similar, "src long, dst long"))
    named = first.join(final, first.id == final.node, "left").select("same", "low", "th", F.coalesce("component", "id").alias("c"))
    head = named.groupBy("c").agg(F.min(F.struct("low", "th")).alias("head"))
    named = named.join(head, "c").select(F.col("same").alias("of"), "head")
    lone = F.col("doc_id").isNull() | F.col("head").isNull()
    best = (F.col("doc_id") == F.col("head.low")) & (F.col("th") == F.col("head.th"))
    out = rows.select("doc_id", "th", "same").join(named, F.col("same") == F.col("of"), "left")
    return out.select("doc_id", F.col("th").alias("text_hash"), F.when(lone, F.col("doc_id")).otherwise(F.col("head.low")).alias("component_id"), (lone | best).alias("kept"))


def _in_parts_of(met: DataFrame, large: DataFrame) -> DataFrame:
    """met(id, key) -> id, g: the ids of a key meet in one place, those of a large(key, m) key in m parts, each with each."""
    large = durable(large)
    if large.isEmpty():
        return met.select("id", F.col("key").alias("g"))
    homes = met.join(large, "key", "left").select("id", "key", F.coalesce("m", F.lit(1)).alias("m")).withColumn("s", F.pmod(F.xxhash64("id"), "m").cast("int"))
    homes = homes.select("id", "key", "s", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("x"))
    return homes.select("id", F.xxhash64("key", F.least("s", "x"), F.greatest("s", "x")).alias("g"))


def _shared_keys(batches: Batches) -> Batches:
    """Rows of the keys that two ids or more hold, as they go by: a run of any length is held in part only."""
    held, told = None, False  # the last row so far, and whether it has gone on
    for rows in batches:
        if not rows.num_rows:
            continue
        key = rows.column(1).to_numpy(zero_copy_only=False)
        same = key[1:] == key[:-1]
        last = held is not None and held.column(1)[0].as_py() == key[0]
        if last and not told:
            yield held
        goes = np.r_[last, same] | np.r_[same, False]
        yield rows.filter(pa.array(goes))
        held, told = rows.slice(rows.num_rows - 1), bool(goes[-1])


def _differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return sum(np.bitwise_count(a[:, None, c] ^ b[None, :, c]).astype(np.int16) for c in range(WIDE_WORDS))


def _few(key: np.ndarray, n: np.ndarray):
    """Row pairs (earlier, later) under one key, lag by lag from the widest, for all runs of FEW rows or fewer at once."""
    small = np.repeat(n, n) <= FEW
    for lag in range(min(FEW, int(n.max(initial=1))) - 1, 0, -1):
        i = np.flatnonzero(small[:-lag] & (key[:-lag] == key[lag:]))
        yield i, i + lag


def _bits_between(fp: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fp[i] ^ fp[j]).sum(1, dtype=np.int16)


def _reached(max_bits: int):
    """(src, dst) under one key within max_bits, enough to connect what lies so near: short runs give all pairs, in long ones
    each row is told by the first that reaches it and is not looked at again."""

    def tree(fp, ids):
        rest, out = np.arange(len(ids)), []
        while len(rest) > 1:
            front, rest = rest[:1], rest[1:]
            while len(front) and len(rest):
                near = _differing(fp[front[:32]], fp[rest]) <= max_bits
                hit = near.any(0)
                out.append((ids[front[near[:, hit].argmax(0)]], ids[rest[hit]]))
                front, rest = np.r_[front[32:], rest[hit]], rest[~hit]
        return out

    def run(batches: Batches) -> Batches:
        for t in _keyed_runs(in_parts(batches), "g", 0):
            g, ids, fp = _col(t, "g"), _col(t, "id"), _words(t.column("fp"))
            at, n = runs_of(g)
            out = [(ids[:0], ids[:0])]
            for i, j in _few(g, n):
                near = _bits_between(fp, i, j) <= max_bits
                out.append((ids[i[near]], ids[j[near]]))
            for a, m in zip(at[n > FEW], n[n > FEW]):
                out += tree(fp[a : a + m], ids[a : a + m])
            yield _batch([np.concatenate(x) for x in zip(*out)], ["src", "dst"])

    return run


def _similar(batches: Batches) -> Batches:
    """(src, dst) of each block whose shingle sets have a Jaccard similarity of SIMILAR or more, enough to connect all such.

    Shared shingles are counted by postings: a set's shingles name the sets that hold them.
    """
    for t in _keyed_runs(in_parts(batches), "g", 0):
        g, all_ids, all_sides, hs = _col(t, "g"), _col(t, "id"), _col(t, "s"), t.column("hs").to_pylist()
        src, dst = [], []
        for a, m in zip(*runs_of(g)):
            ids, side, sets = all_ids[a : a + m], all_sides[a : a + m], [np.frombuffer(x, np.uint64) for x in hs[a : a + m]]
            size = np.array([len(x) for x in sets])
            owner, (_, feature, many) = np.repeat(np.arange(m), size), np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            holders, start = owner[np.argsort(feature, kind="stable")], np.cumsum(many) - many
            offset, label = np.cumsum(size) - size, np.arange(m)
            crossing = side.min() < side.max()
            for x in range(m):
                f = feature[offset[x] : offset[x] + size[x]]
                n = many[f]
                if n.sum() == len(f):
                    continue
                at = np.repeat(start[f] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                both = np.bincount(holders[at], minlength=m)
                like = (both >= SIMILAR * (size[x] + size - both)) & (label != label[x])
                if crossing:
                    like &= side != side[x]
                found, one = np.unique(label[like], return_index=True)
                src += [ids[x]] * len(found)
                dst += ids[np.flatnonzero(like)[one]].tolist()
                label[np.isin(label, found)] = label[x]
        yield _batch([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])
