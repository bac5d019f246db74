"""Removal of repeated byte strings by a depth-limited radix order of suffixes.

Two suffixes that agree on their first ``min_bytes`` bytes are one repeated window; nothing beyond that depth matters.
The order is built by most-significant-digit passes, each a Spark shuffle that keeps only groups still larger than one:

1. digit one: a window's *anchor*, the smallest-hash 28-gram inside it. Equal windows have equal anchors, and
   neighbouring windows share one, so about one row per 12 bytes is dealt out instead of one per byte. Anchors that
   occur in one document only are done.
2. digit two: the whole *segment* of consecutive windows that own a repeated anchor. A segment met in a smaller
   document is covered; an anchor with one segment only is done.
3. the windows themselves, for anchors with several segments (the edges of repeated passages): first inside each batch
   by radix passes over their bytes, 8 at a time, then across batches.

Whole copies of a smaller document are known by the hash of their text and take no part. Texts travel once, compressed,
to checkpointed partitions by doc_id; every later pass brings its short lists there.

Every map side first settles what one Arrow batch can settle alone (a key seen in two of its documents is repeated
whatever the rest holds), so a key that a third of all rows share sends one row per batch and not one per document.
Across batches, segments and windows are compared by a 64-bit hash within a 48-bit anchor, 112 bits in all.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import Batches, durable, in_parts, runs_of

MIN_BYTES = 50
ANCHOR_BYTES = 28
SLICE = 1 << 20
_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_NONE = np.uint64(1 << 63)


def _words(buf: np.ndarray) -> np.ndarray:
    """The little-endian 8-byte word that starts at each byte."""
    return np.ndarray((len(buf) - 7,), "<u8", buf, 0, (1,)).copy()


def _anchor_hash(u: np.ndarray, k: int) -> np.ndarray:
    n = len(u) + 7 - k + 1
    h = u[:n] * _C1
    h ^= h >> np.uint64(29)
    for at in [*range(8, k - 8, 8), k - 8]:
        h += u[at : at + n]
        h *= _C2
        h ^= h >> np.uint64(32)
    h *= _C3
    return h >> np.uint64(16)


def _window_hash(u: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    h = np.zeros(len(at), np.uint64)
    for o in [*range(0, width - 8, 8), width - 8]:
        h ^= u[at + o]
        h *= _C1
        h ^= h >> np.uint64(31)
    h *= _C2
    return h ^ (h >> np.uint64(29))


def _sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    m, p = h, 1
    while 2 * p <= w:
        m = np.minimum(m[:-p], m[p:])
        p *= 2
    return np.minimum(m[: len(h) - w + 1], m[w - p : len(h) - p + 1]) if p < w else m


class Slice:
    """Runs of windows that share an anchor, over some documents' bytes laid end to end."""

    def __init__(self, pieces: list[tuple[int, int, bytes]], width: int, k: int):
        self.width, sizes = width, np.array([len(p[2]) for p in pieces])
        self.buf = np.frombuffer(b"".join(p[2] for p in pieces), np.uint8)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.row, self.base = np.array([p[0] for p in pieces]), np.array([p[1] for p in pieces])
        self.u = _words(self.buf)
        w = width - k + 1
        m = _sliding_min(_anchor_hash(self.u, k), w)
        for e in self.ends[:-1]:
            m[e - width + 1 : e] = _NONE
        at, n = runs_of(m)
        keep = m[at] != _NONE
        at, n = at[keep], n[keep]
        if len(n) and n.max() > w:  # text with a short period: one anchor many times
            parts = -(-n // w)
            first = np.repeat(at, parts)
            k_th = np.arange(len(first)) - np.repeat(np.cumsum(parts) - parts, parts)
            n = np.minimum(w, np.repeat(n, parts) - k_th * w)
            at = first + k_th * w
        self.at, self.n, self.key = at, n, m[at].astype(np.int64)
        self.piece = np.searchsorted(self.starts, at, "right") - 1
        self.rows = self.row[self.piece]

    def segment_hash(self, which: np.ndarray) -> np.ndarray:
        """Of the bytes from the first window's start to the last one's end, for the chosen runs."""
        at, n = self.at[which], self.n[which]
        h = _window_hash(self.u, at, self.width) * _C3 + _window_hash(self.u, at + n - 1, self.width)
        h ^= h >> np.uint64(30)
        return ((h + n.astype(np.uint64)) * _C2).view(np.int64)


def _slices(texts: list, width: int, k: int):
    """Slices of about a megabyte; a longer document is cut so that each window lies in one slice."""
    pieces, size = [], 0
    for i, b in enumerate(texts):
        for s in range(0, max(0, len(b) - width + 1), SLICE):
            pieces.append((i, s, b[s : s + SLICE + width - 1]))
            size += len(pieces[-1][2])
            if size >= SLICE:
                yield Slice(pieces, width, k)
                pieces, size = [], 0
    if pieces:
        yield Slice(pieces, width, k)


def _pack(batches: Batches) -> Batches:
    for rows in in_parts(batches):
        raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in rows.column(1).to_pylist()]
        blobs = [zstandard.ZstdCompressor(level=1).compress(b) for b in raw]
        rest = range(3, rows.num_columns)
        yield _batch([rows.column(0), rows.column(2), pa.array(blobs, pa.binary()), *(rows.column(k) for k in rest)], ["doc_id", "th", "blob", *(rows.schema.names[k] for k in rest)])


def _unpack(column: pa.Array) -> list[bytes]:
    d = zstandard.ZstdDecompressor()
    return [d.decompress(b) for b in column.to_pylist()]


def radix_groups(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal rows of a byte matrix by most-significant-digit passes of 8 bytes: (row numbers in order, group of each).

    Rows that a pass leaves alone in their group are dropped at once, so the result holds repeated rows only.
    """
    n, width = rows.shape
    live, group = np.arange(n), np.zeros(n, np.int64)
    for at in [*range(0, width - 8, 8), width - 8]:
        if not len(live):
            break
        digit = np.ascontiguousarray(rows[live, at : at + 8]).view(">u8").ravel()
        order = np.lexsort((digit, group))
        live, group, digit = live[order], group[order], digit[order]
        new = np.r_[True, (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])]
        group = np.cumsum(new) - 1
        many = np.bincount(group)[group] > 1
        live, group = live[many], group[many]
    return live, group


def _distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    keep = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, bool)
    return a[keep], b[keep]


_ANCHORS = "key long, doc long"  # key: the anchor, then a bit "the batch's documents are told", then a bit "tells one"


def _anchor_map(width: int, k: int):
    """(key, doc) once per key and batch; where a batch holds a key in several documents, these are told directly."""

    def run(batches: Batches) -> Batches:
        for rows in in_parts(batches):
            docs = rows.column(0).to_numpy(zero_copy_only=False)
            keys, owners = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for s in _slices(_unpack(rows.column(1)), width, k):
                keys.append(s.key)
                owners.append(docs[s.rows])
            key, doc = _distinct_pairs(np.concatenate(keys), np.concatenate(owners))
            at, n = runs_of(key)
            many = np.repeat(n > 1, n)
            first = np.zeros(len(key), bool)
            first[at] = True
            key, doc = np.r_[key[first] << 2 | many[first] << 1, key[many] << 2 | 1], np.r_[doc[first], doc[many]]
            order = np.argsort(doc, kind="stable")  # like beside like compresses
            yield _batch([key[order], doc[order]], ["key", "doc"])

    return run


def _batch(columns: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)


def _keyed_runs(batches: Batches, key: str = "key", shift: int = 2):
    """Tables of whole runs of a sorted key without its flags: what may go on is held back, and joined once its run ends."""
    held, open_key = [], None
    for rows in batches:
        if not rows.num_rows:
            continue
        k = rows.column(rows.schema.get_field_index(key)).to_numpy(zero_copy_only=False) >> shift
        last = int(np.flatnonzero(k != k[-1])[-1]) + 1 if k[0] != k[-1] else 0
        if held and (last or k[0] != open_key):
            whole = int(np.searchsorted(k != open_key, True)) if k[0] == open_key else 0
            yield pa.Table.from_batches([*held, rows.slice(0, whole)])
            held = []
            if last > whole:
                yield pa.Table.from_batches([rows.slice(whole, last - whole)])
        elif last:
            yield pa.Table.from_batches([rows.slice(0, last)])
        held.append(rows.slice(last))
        open_key = k[-1]
    if held:
        yield pa.Table.from_batches(held)


def _col(t: pa.Table, name: str) -> np.ndarray:
    c = t.column(name)
    return (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c).to_numpy(zero_copy_only=False)


def _anchor_reduce(batches: Batches) -> Batches:
    """Documents of each key that occurs in two or more."""
    for t in _keyed_runs(batches):
        key, doc = _col(t, "key"), _col(t, "doc")
        told, direct, key = key & 2 > 0, key & 1 > 0, key >> 2
        out = [(doc[direct], key[direct])]
        key, doc, told = key[~direct], doc[~direct], told[~direct]
        at, n = runs_of(key)
        if len(at):
            again = (np.minimum.reduceat(doc, at) < np.maximum.reduceat(doc, at)) | np.logical_or.reduceat(told, at)
            pick = np.repeat(again, n) & ~told
            out.append((doc[pick], key[pick]))
        yield _batch([np.concatenate(x) for x in zip(*out)], ["doc", "key"])


_SEGMENTS = "key long, sh long, doc long"  # key: anchor (2, 3: doc), then two bits: 0 open, 1 the batch's rows are told, 2 covered, 3 edge


def _segment_map(width: int, k: int):
    def run(batches: Batches) -> Batches:
        for rows in in_parts(batches):
            docs, wanted = rows.column(0).to_numpy(zero_copy_only=False), rows.column(2)
            keys, shs, owners = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            repeated = np.unique(wanted.flatten().to_numpy(zero_copy_only=False))
            for s in _slices(_unpack(rows.column(1)), width, k):
                which = np.flatnonzero(_member(s.key, repeated))
                keys.append(s.key[which])
                shs.append(s.segment_hash(which))
                owners.append(docs[s.rows[which]])
            yield _segment_rows(*map(np.concatenate, (keys, shs, owners)))

    return run


def _member(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(x), bool)
    return ordered[np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)] == x


def _segment_rows(key: np.ndarray, sh: np.ndarray, doc: np.ndarray) -> pa.RecordBatch:
    """The first document of each segment stays open; a key with several segments in the batch has edges."""
    order = np.lexsort((doc, sh, key))
    key, sh, doc = key[order], sh[order], doc[order]
    new_key = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
    new = new_key | np.r_[True, sh[1:] != sh[:-1]] if len(key) else new_key
    first_doc = doc[new][np.cumsum(new) - 1] if len(key) else doc
    covered = doc > first_doc
    if len(key):
        keep = new | (covered & np.r_[True, (sh[1:] != sh[:-1]) | (doc[1:] != doc[:-1])])
        key, sh, doc, new, covered, new_key = (x[keep] for x in (key, sh, doc, new, covered, new_key))
    rep_key, rep_sh, rep_doc = key[new], sh[new], doc[new]
    at, n = runs_of(rep_key)
    edge = np.zeros(len(rep_key), bool)
    if len(at):
        edge = np.repeat((n > 1) & (np.minimum.reduceat(rep_doc, at) < np.maximum.reduceat(rep_doc, at)), n)
    mark = np.zeros(len(rep_key), bool)
    mark[at] = True
    mark &= edge
    parts = lambda a, c: np.r_[a[~edge], a[edge], a[mark], c[covered]]
    kind = np.repeat([0, 3, 1, 2], [(~edge).sum(), edge.sum(), mark.sum(), covered.sum()])
    key, sh, doc = parts(rep_key, key), parts(rep_sh, sh), parts(rep_doc, doc)
    key = np.where(kind < 2, key, doc) << 2 | kind
    order = np.argsort(doc, kind="stable")
    return _batch([key[order], sh[order], doc[order]], ["key", "sh", "doc"])


def _segment_reduce(batches: Batches) -> Batches:
    """(doc, sh, edge): covered segments and those whose windows have to be compared one by one."""
    for t in _keyed_runs(batches):
        key, sh, doc = (_col(t, c) for c in ("key", "sh", "doc"))
        kind, key = key & 3, key >> 2
        done = kind >= 2
        out = [(doc[done], sh[done], kind[done] == 3)]
        key, sh, doc, kind = key[~done], sh[~done], doc[~done], kind[~done]
        at, n = runs_of(key)
        if len(at):
            told = np.repeat(np.logical_or.reduceat(kind == 1, at), n)
            open_ = kind == 0
            key, sh, doc, told = key[open_], sh[open_], doc[open_], told[open_]
            order = np.lexsort((doc, sh, key))
            key, sh, doc, told = key[order], sh[order], doc[order], told[order]
            at, n = runs_of(key)
        if len(at):
            new = np.r_[True, (key[1:] != key[:-1]) | (sh[1:] != sh[:-1])]
            covered = doc > doc[new][np.cumsum(new) - 1]
            several = np.add.reduceat(new.astype(np.int64), at) > 1
            several &= np.minimum.reduceat(doc, at) < np.maximum.reduceat(doc, at)
            edge = (told | np.repeat(several, n)) & new
            pick = covered | edge
            out.append((doc[pick], sh[pick], edge[pick]))
        yield _batch([np.concatenate(x) for x in zip(*out)], ["doc", "sh", "edge"])


_WINDOWS = "anchor long, win long, doc long, direct boolean"


def _window_map(width: int, k: int):
    """The windows of edge segments; equal ones of a batch are settled here, by radix passes over their bytes."""

    def run(batches: Batches) -> Batches:
        for rows in in_parts(batches):
            docs, ids = rows.column(0).to_numpy(zero_copy_only=False), rows.column(2)
            wanted = np.unique(ids.flatten().to_numpy(zero_copy_only=False))
            for s in _slices(_unpack(rows.column(1)), width, k):
                sh = s.segment_hash(np.arange(len(s.at)))
                which = np.flatnonzero(_member(sh, wanted))
                if not len(which):
                    continue
                n_of = s.n[which]
                bit = np.arange(n_of.sum()) - np.repeat(np.cumsum(n_of) - n_of, n_of)
                at = np.repeat(s.at[which], n_of) + bit
                doc = np.repeat(docs[s.rows[which]], n_of)
                win = np.lib.stride_tricks.sliding_window_view(s.buf, width)[at]
                live, group = radix_groups(win)
                direct, rest = np.zeros(len(at), bool), np.ones(len(at), bool)
                if len(live):
                    order = np.lexsort((doc[live], group))
                    live, group = live[order], group[order]
                    g, n = runs_of(group)
                    first = np.repeat(doc[live[g]], n)
                    direct[live] = doc[live] > first
                    rest[live] = False
                    rest[live[g]] = True
                pick = direct | rest
                h = _window_hash(s.u, at[pick], width)
                yield _batch([np.repeat(s.key[which], n_of)[pick], h.view(np.int64), doc[pick], direct[pick]], ["anchor", "win", "doc", "direct"])

    return run


def _window_reduce(batches: Batches) -> Batches:
    """Rows come in the order of the windows, smaller documents first; a window is known by its hash and its anchor."""
    for t in _keyed_runs(batches, "win", 0):
        anchor, win, doc, direct = (_col(t, c) for c in ("anchor", "win", "doc", "direct"))
        covered = direct.copy()
        rest = np.flatnonzero(~direct)
        if len(rest):
            w, k = win[rest], anchor[rest]
            new = np.r_[True, (w[1:] != w[:-1]) | (k[1:] != k[:-1])]
            covered[rest] = doc[rest] > doc[rest][new][np.cumsum(new) - 1]
        yield _batch([doc[covered], win[covered]], ["doc", "win"])


def _remove(width: int, k: int, with_text: bool):
    def run(batches: Batches) -> Batches:
        for rows in in_parts(batches):
            raw, copies = _unpack(rows.column(1)), rows.column(4).to_pylist()
            whole, parts = rows.column(2), rows.column(3)
            gone = {i: np.zeros(len(raw[i]) + 1, np.int32) for i in range(len(raw)) if whole[i].is_valid and not copies[i]}
            lists = {i: [np.sort(x[i].values.to_numpy(zero_copy_only=False)) for x in (whole, parts)] for i in gone}
            for s in _slices([b if i in gone else b"" for i, b in enumerate(raw)], width, k):
                for row in np.unique(s.rows):
                    own = np.flatnonzero(s.rows == row)
                    full = _member(s.segment_hash(own), lists[row][0])
                    for runs, wins in ((own[full], None), (own[~full], lists[row][1])):
                        n = s.n[runs]
                        at = np.repeat(s.at[runs], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                        piece = np.repeat(s.piece[runs], n)
                        if wins is not None:
                            hit = _member(_window_hash(s.u, at, width).view(np.int64), wins) if len(wins) else np.zeros(len(at), bool)
                            at, piece = at[hit], piece[hit]
                        at = at - s.starts[piece] + s.base[piece]
                        np.add.at(gone[row], at, 1)
                        np.add.at(gone[row], at + width, -1)
            out = []
            for i, b in enumerate(raw):
                removed, spans, kept = 0, 0, b
                if i in gone:
                    cut = np.cumsum(gone[i])[:-1] > 0
                    removed = int(cut.sum())
                    if removed:
                        spans = int(cut[0]) + int((cut[1:] & ~cut[:-1]).sum())
                        kept = np.frombuffer(b, np.uint8)[~cut].tobytes()
                elif copies[i] and len(b) >= width:
                    removed, spans, kept = len(b), 1, b""
                extra = (kept.decode("utf-8", "ignore"),) if with_text else ()
                out.append((len(b), removed, spans, hashlib.sha256(kept).hexdigest(), *extra))
            cols = list(zip(*out)) or [()] * (4 + with_text)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            rest = range(5, rows.num_columns)
            columns = [rows.column(0), *(pa.array(c, ty) for c, ty in zip(cols, types)), *(rows.column(k) for k in rest)]
            yield _batch(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept_text"] * with_text, *(rows.schema.names[k] for k in rest)])

    return run


def remove_repeats(docs: DataFrame, min_bytes: int = MIN_BYTES, with_text: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Drop each byte covered by a ``min_bytes`` string that also starts in a document with a smaller doc_id.

    docs(doc_id long, text string) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept_text, which leaves out
    bytes of a character that was cut in two). The columns named in ``keep`` come along; others are ignored, whatever their
    names. Null text is an
    empty one; texts shorter than min_bytes stay whole. Rows with a null doc_id have no place in the order: they lose
    nothing and nothing is lost to them. Rows that share a doc_id are judged each against smaller ids only. An empty
    table gives an empty result.
    """
    width, k = min_bytes, min(ANCHOR_BYTES, min_bytes)
    if not 16 <= min_bytes <= 82:
        raise ValueError("min_bytes must be 16 to 82: a segment is known by its first and last window, which have to meet")
    kept = {f"kept_{k}": kind for k, kind in docs.dtypes if k in keep}
    pair = docs.select("doc_id", "text", F.xxhash64("text").alias("th"), *[F.col(k[5:]).alias(k) for k in kept])
    known = pair.where("doc_id is not null")
    hashes = known.select("doc_id", "th", F.xxhash64("text", F.lit(1)).alias("th2"), F.octet_length("text").alias("n"))
    first = hashes.groupBy("th", "th2", "n").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    copies = hashes.join(first.drop("last"), ["th", "th2", "n"]).where("doc_id > first").groupBy(F.col("doc_id").alias("copy")).agg(F.collect_set("th").alias("ths"))
    packed = "doc_id long, th long, blob binary" + "".join(f", `{k}` {kind}" for k, kind in kept.items())
    text = durable(known.mapInArrow(_pack, packed).repartition("doc_id"), partitioned=True)
    own = text.join(copies, text.doc_id == copies.copy, "left").where("ths is null or not array_contains(ths, th)")
    anchors = own.select("doc_id", "blob").mapInArrow(_anchor_map(width, k), _ANCHORS)
    dealt = anchors.repartition(F.expr("if(key & 1 = 1, doc, key >> 2)")).sortWithinPartitions("key")
    keys = dealt.mapInArrow(_anchor_reduce, "doc long, key long").groupBy("doc").agg(F.collect_list("key").alias("keys"))
    keys = durable(keys, partitioned=True)  # the anchors' shuffle files go before the next pass
    joined = own.join(keys, own.doc_id == keys.doc).select("doc_id", "blob", "keys")
    segments = joined.mapInArrow(_segment_map(width, k), _SEGMENTS)
    dealt = segments.repartition(F.expr("if(key & 2 = 2, doc, key >> 2)")).sortWithinPartitions("key")
    found = durable(dealt.mapInArrow(_segment_reduce, "doc long, sh long, edge boolean"))
    edges = found.where("edge").groupBy("doc").agg(F.collect_list("sh").alias("shs"))
    joined = own.join(edges, own.doc_id == edges.doc).select("doc_id", "blob", "shs")
    windows = joined.mapInArrow(_window_map(width, k), _WINDOWS)
    dealt = windows.repartition(F.when(F.col("direct"), F.col("doc")).otherwise(F.col("win"))).sortWithinPartitions("win", "anchor", "doc")
    at_edges = dealt.mapInArrow(_window_reduce, "doc long, win long")
    none = F.lit(None).cast("long")
    covered = found.where("not edge").select("doc", "sh", none.alias("win")).union(at_edges.select("doc", none, "win"))
    covered = covered.groupBy("doc").agg(F.collect_list("sh").alias("whole"), F.collect_list("win").alias("parts"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * with_text + "".join(f", `{k}` {kind}" for k, kind in kept.items())
    joined = text.join(covered, text.doc_id == covered.doc, "left").join(copies, text.doc_id == copies.copy, "left")
    joined = joined.select("doc_id", "blob", "whole", "parts", F.expr("coalesce(array_contains(ths, th), false)").alias("copied"), *kept)
    lone = pair.where("doc_id is null").mapInArrow(_pack, packed)
    lone = lone.select("doc_id", "blob", *(F.lit(None).cast("array<long>").alias(c) for c in ("whole", "parts")), F.lit(False).alias("copied"), *kept)
    out = joined.union(lone).mapInArrow(_remove(width, k, with_text), schema)
    return out.withColumnsRenamed({k: k[5:] for k in kept})
