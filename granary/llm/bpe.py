"""BPE encoding and decoding with a contiguous rank array per word.

A word is a short row of parts with, beside it, the row of ranks of adjacent parts. The smallest rank is scanned for,
its boundary deleted and the one or two neighbouring ranks refreshed, until no adjacent pair has a rank. The words that
a worker has not met before are merged together, as the rows of two matrices; a text is then a join over its words.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import Batches, in_parts, texts

NO_RANK = (1 << 31) - 1
LONG_WORD = 400
CACHED_WORDS = 300_000


def default_vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """A printable letter for each byte: printable Latin-1 stays, the rest moves up past U+0100 in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, moved = [""] * 256, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + moved)
            moved += 1
    return out


# Letters and numbers younger than the tables by which the vocabularies' texts are split; there they are
# neither. And capitals younger than this Python's tables, first and last of a run, with the distance of their small letters.
YOUNG_LETTERS = (
    "\u0558 \u058b-\u058c \u088f \u0c5c \u0cdc \u208f \u209d-\u209f \ua7ce-\ua7cf \ua7d2 \ua7d4 \ua7dd \ua7e2 \ua7f1 \uab6c-\uab6d "
    "\U000107bb-\U000107bf \U00010940-\U00010959 \U00010ec5-\U00010ec7 \U00010ed9-\U00010eee \U00011b0a \U00011db0-\U00011ddb \U00011df1 "
    "\U00016ea0-\U00016eb8 \U00016ebb-\U00016ed3 \U00016ff2-\U00016ff3 \U000187f8-\U000187ff \U00018cd6-\U00018cda \U00018d09-\U00018d20 "
    "\U00018d80-\U00018df2 \U00018e00-\U00019191 \U000191a0-\U000191d2 \U0001b123-\U0001b128 \U0001b168 \U0001d6a6 \U0001df1f-\U0001df24 "
    "\U0001df2b-\U0001df81 \U0001df90-\U0001df96 \U0001dfcd-\U0001dfff \U0001e6c0-\U0001e6de \U0001e6e0-\U0001e6e2 \U0001e6e4-\U0001e6e5 "
    "\U0001e6e7-\U0001e6ed \U0001e6f0-\U0001e6f4 \U0001e6fe-\U0001e6ff \U0002b73a-\U0002b73f \U0002b81e \U0002cea2-\U0002cead \U000323b0-\U00033479 "
    "\U0003d000-\U0003fc3f"
)
YOUNG_NUMBERS = "\U00011de0-\U00011de9 \U0001246f \U00012475-\U0001247f \U00012550-\U00012686 \U00016ff4-\U00016ff6"
YOUNG_CAPITALS = (
    (0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1),
    (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, 0x19B - 0xA7DC), (0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B),
)
_SMALL = {c: c + d for a, z, d in YOUNG_CAPITALS for c in range(a, z + 1)}
_YL, _YN = YOUNG_LETTERS.replace(" ", ""), YOUNG_NUMBERS.replace(" ", "")
_L, _N, _OTHER = rf"[\p{{L}}--[{_YL}]]", rf"[\p{{N}}--[{_YN}]]", rf"[[^\p{{White_Space}}\p{{L}}\p{{N}}]||[{_YL}{_YN}]]"
WORD_PATTERN = rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|{_L}+|{_N}|{_OTHER}+"
BYTE_PATTERN = rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d| ?{_L}+| ?{_N}+| ?{_OTHER}+|\p{{White_Space}}+(?!\P{{White_Space}})|\p{{White_Space}}+"
# The same for texts of Latin letters alone, in the faster standard module; a letter is the likeliest, so it comes first.
_LATIN = "[" + "".join(chr(c) for c in range(0x250) if chr(c).isalpha()) + "]"
_LATIN_WORD = re.compile(_LATIN + r"+|'s|'t|'re|'ve|'m|'ll|'d|\d|(?:[^\s\w]|_)+")
_LATIN_BYTE = re.compile(" ?" + _LATIN + r"+|'s|'t|'re|'ve|'m|'ll|'d| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_BEYOND_LATIN = re.compile("[^\x00-\x1b\x20-\xa0\xc0-\u024f]")
# Combining marks younger than the tables by which the vocabulary's texts are normalised; there they are
# plain characters, over which nothing is reordered or composed.
YOUNG_MARKS = (
    "\u07fd \u0898-\u089f \u08ca-\u08d3 \u09fe \u0c3c \u0d3b-\u0d3c \u0eba \u1715 \u1abf-\u1ace \u1df6-\u1dfa \ua82c "
    "\U00010d24-\U00010d27 \U00010eab-\U00010eac \U00010efd-\U00010eff \U00010f46-\U00010f50 \U00010f82-\U00010f85 \U00011070 "
    "\U0001133b \U0001145e \U00011839-\U0001183a \U00011930 \U0001193d-\U0001193e \U00011943 \U000119e0 \U00011a34 \U00011a47 \U00011a99 "
    "\U00011d42 \U00011d44-\U00011d45 \U00011d97 \U00011f41-\U00011f42 \U00016ff0-\U00016ff1 \U0001e08f \U0001e130-\U0001e136 \U0001e2ae "
    "\U0001e2ec-\U0001e2ef \U0001e4ec-\U0001e4ef"
)
_YOUNG = re.compile("([" + YOUNG_MARKS.replace(" ", "") + "]+)")
_BREAK = re.compile("(?<=[A-Za-z0-9.,])[ \n]")
CHUNK = 1 << 20
WIDTHS = (1, 4, 6, 8, 10, 12, 14, 16, 20, 24, 32, 48, 64)


def composed(text: str) -> str:
    """Canonical composition, younger marks left as they are."""
    return "".join([x if k % 2 else unicodedata.normalize("NFC", x) for k, x in enumerate(_YOUNG.split(text))])


def chunks(text: str, size: int = CHUNK):
    """A long text in parts that begin at white space after a Latin letter, digit or stop, where no word goes across."""
    at = 0
    while len(text) - at > size and (cut := _BREAK.search(text, at + size)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


class PairRanks:
    """Rank of a pair of token ids by open addressing in arrays, for many pairs at once."""

    def __init__(self, rank: dict[int, int], shift: int):
        self.shift, self.bits = shift, max(4, (4 * len(rank)).bit_length())
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NO_RANK, np.int32)
        keys, ranks = np.fromiter(rank, np.int64, len(rank)), np.fromiter(rank.values(), np.int64, len(rank))
        at = self._home(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]
            put = self.keys[at] == keys
            self.ranks[at[put]] = ranks[put]
            keys, ranks, at = keys[~put], ranks[~put], at[~put] + 1 & (1 << self.bits) - 1

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.int64) << self.shift | b
        at = self._home(keys)
        out, seen = self.ranks[at], self.keys[at]
        todo = np.flatnonzero(seen != keys)
        out[todo] = NO_RANK
        todo = todo[seen[todo] >= 0]
        while len(todo):
            at[todo] = at[todo] + 1 & (1 << self.bits) - 1
            seen = self.keys[at[todo]]
            hit = seen == keys[todo]
            out[todo[hit]] = self.ranks[at[todo[hit]]]
            todo = todo[~hit & (seen >= 0)]
        return out


class RankBPE:
    """One vocabulary file; per word a tuple of ids, memoised."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.lower = "Lowercase" in json.dumps(spec.get("normalizer"))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.shift = max(self.token).bit_length()
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for rank, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.rank.setdefault(self.vocab[a] << self.shift | self.vocab[b], rank)
            self.made.append(self.vocab[a + b])
        self.pairs = PairRanks(self.rank, self.shift)
        letters = byte_letters()
        self.first = [self.vocab[x] for x in letters]
        self.last = [self.vocab[x + self.suffix] for x in letters]
        self._split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self._full = regex.compile(WORD_PATTERN if self.suffix else BYTE_PATTERN)
        self._latin = _LATIN_WORD if self.suffix else _LATIN_BYTE
        self.made_of = np.array(self.made, np.int32)
        self.first_of, self.last_of = np.array(self.first, np.int32), np.array(self.last, np.int32)
        self.names = [self.token.get(i, "") for i in range(max(self.token) + 1)]
        self.digits = [str(i) for i in range(len(self.names))]

    def words(self, text: str) -> list[str]:
        """Normalised words of a text without special tokens; Latin letters alone are composed as they stand."""
        plain = not _BEYOND_LATIN.search(text)
        if self.suffix and not plain:
            text = composed(text)
        if self.lower:
            text = text.replace("Σ", "σ").lower()  # letter by letter: no final sigma
            plain = plain and "\u0307" not in text
            text = text if plain else text.translate(_SMALL)
        return (self._latin if plain else self._full).findall(text)

    def parts(self, text: str) -> list[tuple[bool, str]]:
        """(is a special token, text)"""
        if self._split is None or "<|" not in text:
            return [(False, text)]
        return [(x in self.special, x) for x in self._split.split(text) if x]

    def merge(self, word: str) -> list[int]:
        raw = word.encode("utf-8", "surrogatepass")
        parts = [self.first[b] for b in raw[:-1]] + [self.last[raw[-1]]]
        if len(parts) > LONG_WORD:
            return self._merge_long(parts)
        rank, made, shift = self.rank.get, self.made, self.shift
        ranks = [rank(a << shift | b, NO_RANK) for a, b in zip(parts, parts[1:])]
        while ranks:
            r = min(ranks)
            if r == NO_RANK:
                break
            i = ranks.index(r)
            parts[i] = made[r]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank(parts[i] << shift | parts[i + 1], NO_RANK)
            if i:
                ranks[i - 1] = rank(parts[i - 1] << shift | parts[i], NO_RANK)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        """The same merges with a heap, for words whose scans would take quadratic time."""
        n, rank, shift = len(parts), self.rank.get, self.shift
        nxt, prv = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank(parts[i] << shift | parts[i + 1], -1)) >= 0]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j], nxt[i] = self.made[r], -1, nxt[j]
            if nxt[j] >= 0:
                prv[nxt[j]] = i
            for x in (prv[i], i):
                if x >= 0 and nxt[x] >= 0 and (q := rank(parts[x] << shift | parts[nxt[x]], -1)) >= 0:
                    heapq.heappush(heap, (q, x, parts[x], parts[nxt[x]]))
        return [p for p in parts if p >= 0]

    def merged(self, words: list[str]):
        """Blocks of (which words, their numbers of parts, parts, bytes), the last two as matrices padded to the right."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        order = np.argsort(size, kind="stable")
        cuts = [0, *np.searchsorted(size[order], WIDTHS, "right")]
        for lo, hi in zip(cuts, cuts[1:]):
            for at in range(lo, hi, 1 << 13):
                which = order[at : min(hi, at + (1 << 13))]
                width = int(size[which[-1]])
                text = np.frombuffer(b"".join([raw[i].ljust(width, b"\0") for i in which]), np.uint8).reshape(-1, width)
                yield which, *self._merge_rows(text, size[which]), text
        for i in order[cuts[-1] :]:
            parts = np.array([self.merge(words[i])])
            yield np.array([i]), np.array([parts.shape[1]]), parts, np.frombuffer(raw[i], np.uint8)[None]

    def _merge_rows(self, text: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows, width = text.shape
        cols, at = np.arange(width), np.arange(rows)
        parts, n = self.first_of[text], n.copy()
        parts[at, n - 1] = self.last_of[text[at, n - 1]]
        ranks = np.full((rows, width), NO_RANK, np.int32)
        inside = cols < n[:, None] - 1
        ranks[inside] = self.pairs(parts[inside], parts[:, 1:][inside[:, :-1]])
        live, out, out_n = at, parts.copy(), n.copy()
        while len(live):
            i = ranks.argmin(1)
            least = ranks[at[: len(live)], i]
            go = least < NO_RANK
            if not go.all():
                out[live[~go]], out_n[live[~go]] = parts[~go], n[~go]
                parts, ranks, n, live, i, least = (x[go] for x in (parts, ranks, n, live, i, least))
            k = at[: len(live)]
            parts[k, i] = self.made_of[least]
            parts = np.take_along_axis(parts, np.minimum(cols + (cols > i[:, None]), width - 1), 1)
            ranks = np.take_along_axis(ranks, np.minimum(cols + (cols >= i[:, None]), width - 1), 1)
            n -= 1
            right, left = i < n - 1, i > 0
            ranks[k[~right], i[~right]] = NO_RANK
            ranks[k[right], i[right]] = self.pairs(parts[k[right], i[right]], parts[k[right], i[right] + 1])
            ranks[k[left], i[left] - 1] = self.pairs(parts[k[left], i[left] - 1], parts[k[left], i[left]])
        return out_n, out

    def decode(self, ids: list[int]) -> str:
        """Token names joined by spaces where words have ends and no decoder; else the bytes they stand for."""
        names = map(self.names.__getitem__, ids)
        if self.suffix:
            return " ".join(names)
        special = set(self.special.values())
        return b"".join(self.names[i].encode() if i in special else bytes(map(_BYTE_OF.__getitem__, self.names[i])) for i in ids).decode("utf-8", "replace")


_BYTE_OF = {x: b for b, x in enumerate(byte_letters())}


class PerWord(dict):
    """word -> what ``make`` derives from it, for lists of words at once; emptied when full."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def learn(self, words: set[str]) -> None:
        if len(self) > CACHED_WORDS:
            self.clear()
        if missing := list(words.difference(self)):
            self.update(self.make(missing))


def known_words(bpe: RankBPE, memo: PerWord, texts: list[str]):
    """(row, words) of every text, part by part in order; memo holds the words that are yielded."""
    ready, size = [], 0
    for row, text in enumerate(texts):
        for part in chunks(text):
            ready.append((row, all_words(bpe, part)))
            size += len(part)
            if size >= CHUNK:
                memo.learn(set().union(*(w for _, w in ready)))
                yield from ready
                ready, size = [], 0
    memo.learn(set().union(*(w for _, w in ready)))
    yield from ready


@lru_cache(maxsize=4)
def load(path: str) -> RankBPE:
    return RankBPE(path)


@lru_cache(maxsize=4)
def raw_ids(path: str) -> PerWord:
    """word -> its ids as little-endian 32-bit integers"""
    bpe = load(path)

    def make(words):
        special = {w: np.array([bpe.special[w[1:]]], "<u4").tobytes() for w in words if w[0] == "\0" and w[1:] in bpe.special}
        yield from special.items()
        words = [w for w in words if w not in special]
        for which, n, parts, _ in bpe.merged(words):
            flat = parts[np.arange(parts.shape[1]) < n[:, None]].astype("<u4").tobytes()
            ends = (4 * np.cumsum(n)).tolist()
            for i, a, b in zip(which.tolist(), [0, *ends], ends):
                yield words[i], flat[a:b]

    return PerWord(make)


def all_words(bpe: RankBPE, text: str) -> list[str]:
    """Words of a whole text; a special token stands as NUL and its name (no word starts with NUL and a letter or <)."""
    if "<|" not in text:
        return bpe.words(text)
    out = []
    for special, part in bpe.parts(text):
        out += ["\0" + part] if special else bpe.words(part)
    return out


def encode_rows(path: str, texts: list[str]) -> list[bytes]:
    """Ids of each text as little-endian 32-bit integers."""
    memo, out = raw_ids(path), [[] for _ in texts]
    for row, words in known_words(load(path), memo, texts):
        out[row] += map(memo.__getitem__, words)
    return [b"".join(x) for x in out]


def encode_raw(path: str, text: str) -> bytes:
    return encode_rows(path, [text])[0]


def encode_decode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_tokens long, ids_sha256, decoded_sha256 for every whole text, in one narrow pass.

    The decoded text is made of the ids. Null text counts as empty (no tokens, both hashes those of an empty string). Nulls
    in doc_id and repeated rows pass through; other columns are ignored. vocabulary: path of a BPE file; by default the
    public 49k word vocabulary as the worker finds it.
    """

    def run(batches: Batches) -> Batches:
        path = vocabulary or default_vocabulary("word_bpe_49k.json")
        bpe = load(path)
        for rows in in_parts(batches, CHUNK):
            n, ids_hash, text_hash = [], [], []
            for raw in encode_rows(path, texts(rows.column(1))):
                ids = np.frombuffer(raw, "<u4").tolist()
                n.append(len(ids))
                ids_hash.append(hashlib.sha256(" ".join(map(bpe.digits.__getitem__, ids)).encode()).hexdigest())
                text_hash.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """docs(doc_id, text) -> doc_id, ids array<int>: the ids themselves; a null text has none."""

    def run(batches: Batches) -> Batches:
        path = vocabulary or default_vocabulary("word_bpe_49k.json")
        for rows in in_parts(batches, CHUNK):
            ids = [np.frombuffer(raw, "<i4") for raw in encode_rows(path, texts(rows.column(1)))]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, ids) -> doc_id, text: tokens joined as the vocabulary's decoder joins them; null ids give an empty text."""

    def run(batches: Batches) -> Batches:
        bpe = load(vocabulary or default_vocabulary("word_bpe_49k.json"))
        for rows in in_parts(batches):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([bpe.decode(ids or []) for ids in rows.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, text string")
