"""Column helpers on strings: letter counts and format strings."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from string import ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf


def text_bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows in one array, and where each row begins in it, with the end of the last; nulls are empty."""
    whole = pa.concat_arrays([text.cast(pa.large_binary()).fill_null(b"")])
    begin = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = np.frombuffer(whole.buffers()[2] or b"", np.uint8)
    return data[begin[0] : begin[-1]], begin - begin[0]


def each_row(text: pa.Array) -> Iterator[np.ndarray]:
    """Each row's characters as one byte each; a character beyond ASCII is the first of its bytes."""
    data, begin = text_bytes(text)
    plain, at = not (data > 127).any(), begin.tolist()
    return (row if plain else row[(row & 0xC0) != 0x80] for row in (data[a:b] for a, b in zip(at, at[1:])))


@arrow_udf(T.ArrayType(T.LongType()))
def letter_counts(text: pa.Array) -> pa.Array:
    """How many of each letter A to Z a text holds, counted in one pass over its bytes."""
    n = len(ascii_uppercase)
    counts = np.empty((len(text), n), np.int64)
    for k, row in enumerate(each_row(text)):
        counts[k] = np.bincount(row, minlength=256)[65 : 65 + n]
    begin = pa.array(np.arange(len(text) + 1) * n, pa.int32())
    return pa.ListArray.from_arrays(begin, pa.array(counts.ravel()), mask=text.is_null())


def letter_count(text: Column | str, letters: str) -> Column:
    """How many of the characters of a text are among ``letters``. All counts of one text's letters A to Z come from one pass."""
    text = F.col(text) if isinstance(text, str) else text
    if not letters or not set(letters) <= set(ascii_uppercase):
        return (F.length(text) - F.length(F.translate(text, letters, ""))).cast("long")
    counts = letter_counts(text)
    first, *more = (F.get(counts, F.lit(ascii_uppercase.index(x))) for x in sorted(set(letters)))
    return sum(more, first)


def substring_count(text: Column, part: str) -> Column:
    """Non-overlapping occurrences of a fixed string."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("long")


def weighted_sum(text: Column | str, weights: Mapping[str, float]) -> Column:
    out = F.lit(0.0)
    for letter, w in weights.items():
        out = out + letter_count(text, letter) * F.lit(w)
    return out


def lookup(key: Column, table: Mapping[str, str], default: Column | None = None) -> Column:
    """A small fixed table as a CASE expression, which stays in generated code."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for k, v in table.items():
        out = out.when(key == k, F.lit(v))
    return out if default is None else out.otherwise(default)


def sentence(parts: list[Column], separator: str, end: str) -> Column:
    """Parts that are not null, joined, with a full stop."""
    return F.concat(F.concat_ws(separator, *parts), F.lit(end))
