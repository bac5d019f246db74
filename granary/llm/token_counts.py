"""Token counts of sections by offsets of one encoding of the whole document.

Encoding each section alone would change tokens at its edges. Here a document is encoded once; every token's character
span is joined with the section intervals, and a token over a boundary goes to the section named by the rule.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.bpe import CHUNK, PerWord, default_vocabulary, known_words, load
from granary.llm.common import Batches, in_parts, texts

RULES = ("first", "most")


@lru_cache(maxsize=4)
def _spans(path: str) -> PerWord:
    """piece -> (its tokens' first characters, their ends, the numbers of tokens and characters) as bytes of 32-bit integers"""
    bpe = load(path)
    bytes_of = np.array([len(t) for t in bpe.names])  # one letter of a token is one byte of text

    def make(pieces):
        special = [w for w in pieces if w[0] == "\0" and w[1:] in bpe.special]
        for w in special:
            yield w, tuple(np.array(x, "<i4").tobytes() for x in ([0], [len(w) - 1], [1, len(w) - 1]))
        pieces = list(set(pieces).difference(special))
        for which, n, parts, text in bpe.merged(pieces):
            own = np.arange(parts.shape[1]) < n[:, None]
            ends = np.cumsum(np.where(own, bytes_of[parts], 0), 1)
            char = np.cumsum((text & 0xC0) != 0x80, 1) - 1
            row = np.arange(len(which))[:, None]
            starts, ends = char[row, np.c_[np.zeros(len(which), int), ends[:, :-1]] % text.shape[1]][own], char[row, ends - 1][own] + 1
            sizes = np.c_[n, [len(pieces[i]) for i in which]]
            starts, ends, stop = starts.astype("<i4").tobytes(), ends.astype("<i4").tobytes(), (4 * np.cumsum(n)).tolist()
            sizes = sizes.astype("<i4").tobytes()
            for k, (i, a, b) in enumerate(zip(which.tolist(), [0, *stop], stop)):
                yield pieces[i], (starts[a:b], ends[a:b], sizes[8 * k : 8 * k + 8])

    return PerWord(make)


def spans_of(path: str, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Character spans of the tokens of each whole text; an added token is one token, as it stands."""
    memo, out = _spans(path), [[b"", b"", b""] for _ in texts]
    for row, pieces in known_words(load(path), memo, texts):
        if pieces:
            out[row] = [x + b"".join(y) for x, y in zip(out[row], zip(*map(memo.__getitem__, pieces)))]
    spans = []
    for starts, ends, sizes in out:
        tokens, chars = np.frombuffer(sizes, "<i4").astype(np.int64).reshape(-1, 2).T
        at = np.repeat(np.cumsum(chars) - chars, tokens)
        spans.append((at + np.frombuffer(starts, "<i4"), at + np.frombuffer(ends, "<i4")))
    return spans


def token_spans(path: str, text: str) -> tuple[np.ndarray, np.ndarray]:
    return spans_of(path, [text])[0]


def line_sections(text: str) -> np.ndarray:
    """Starts of the lines; a line holds its own newline."""
    raw = text.encode("utf-32-le", "surrogatepass")
    at = np.flatnonzero(np.frombuffer(raw, "<u4") == 10) + 1
    return np.r_[0, at[at < len(text)]]


def attribute(starts: np.ndarray, ends: np.ndarray, lo: np.ndarray, hi: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Tokens and boundary-crossing tokens of each section (disjoint, ascending), and tokens in no section.

    first: a crossing token counts where its first character lies. most: where most of it lies, ties to the earlier.
    """
    s = np.searchsorted(lo, starts, "right") - 1
    if rule == "most":
        last = np.searchsorted(lo, ends - 1, "right") - 1
        for i in np.flatnonzero(last > s):
            span = np.arange(max(s[i], 0), last[i] + 1)
            s[i] = span[np.argmax(np.minimum(hi[span], ends[i]) - np.maximum(lo[span], starts[i]))]
    inside = (s >= 0) & (np.minimum(ends, hi[s]) > np.maximum(starts, lo[s])) if len(lo) else np.zeros(len(starts), bool)
    own = s[inside]
    crossing = (starts[inside] < lo[own]) | (ends[inside] > hi[own])
    n = np.bincount(own, minlength=len(lo))
    return n, np.bincount(own[crossing], minlength=len(lo)), int(len(starts) - inside.sum())


def token_counts(docs: DataFrame, rule: str = "first", vocabulary: str | None = None) -> DataFrame:
    """docs(doc_id, text[, sections array<struct<start,end>>]) -> a row per section: doc_id, section, start, end, n_tokens, n_crossing, doc_tokens.

    Without a sections column each line, with its newline, is a section. Sections are disjoint and ascending; a document
    without any gets one row with section null and its total. Null or empty text: section null, no tokens. Tokens in no
    section count in doc_tokens only. vocabulary: path of a byte-level BPE file. Nulls in doc_id and repeated rows pass
    through; other columns are ignored.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    kind = "array<struct<start:long,end:long>>"
    given = F.col("sections").cast(kind) if "sections" in docs.columns else F.lit(None).cast(kind)
    own = "sections" in docs.columns

    def run(batches: Batches) -> Batches:
        path = vocabulary or default_vocabulary("byte_bpe_50k.json")
        names = ["doc_id", "section", "start", "end", "n_tokens", "n_crossing", "doc_tokens"]
        for rows in in_parts(batches, CHUNK):
            cols: list[list] = [[] for _ in names]
            ids, whole = rows.column(0).to_pylist(), texts(rows.column(1))
            for i, (text, (starts, ends)) in enumerate(zip(whole, spans_of(path, whole))):
                if own:
                    got = rows.column(2)[i].as_py() or []
                    lo, hi = np.array([x["start"] for x in got], np.int64), np.array([x["end"] for x in got], np.int64)
                else:
                    lo = line_sections(text) if text else np.zeros(0, np.int64)
                    hi = np.r_[lo[1:], len(text)][: len(lo)]
                n, over, _ = attribute(starts, ends, lo, hi, rule)
                many = max(1, len(lo))
                lone = not len(lo)
                for c, v in zip(cols, ([ids[i]] * many, [None] if lone else range(many), [None] if lone else lo.tolist(), [None] if lone else hi.tolist(), [0] if lone else n.tolist(), [0] if lone else over.tolist(), [len(starts)] * many)):
                    c.extend(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

    schema = "doc_id long, section long, start long, end long, n_tokens long, n_crossing long, doc_tokens long"
    return docs.select("doc_id", "text", given.alias("sections")).mapInArrow(run, schema)
