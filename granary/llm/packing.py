"""Packing of tokenised documents into fixed-length training sequences.

Vector bin packing by the dot-product heuristic: an open sequence has room in three quantities at once (tokens, segments,
loss-bearing tokens); of the waiting pieces that fit, the one with the largest dot product of its demand with the room
left goes in. Where none fits, the largest waiting piece is cut to fill the sequence. Each partition packs its own
documents, with a bounded set of waiting pieces, so there is no shuffle and no state beyond a few megabytes.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.bpe import CHUNK, default_vocabulary, encode_rows
from granary.llm.common import Batches, in_parts, texts

END_ID = 1
WAITING = 512
_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Packer:
    """Packs (doc, ids, loss-bearing tokens at the end of the document) into sequences; emits rows of pieces."""

    def __init__(self, first_id: int, tokens: int, segments: int, loss: int):
        self.room_of = np.array([tokens, segments, loss], float)
        self.next_id, self.rows = first_id, []
        self.demand = np.zeros((WAITING, 3))
        self.items: list = [None] * WAITING
        self.free = list(range(WAITING))
        self.open_new()

    def open_new(self) -> None:
        self.room, self.held = self.room_of.copy(), []

    def close(self) -> None:
        """Emit the open sequence. One that its other limits end before it is full is cut into powers of two, which need no
        padding."""
        held, self.held = self.held, []
        left = sum(len(x[1]) for x in held)
        whole, held = int(self.room_of[0]), held[::-1]
        while left:
            want, at = whole if left == whole else 1 << (left.bit_length() - 1), 0
            left -= want
            while at < want:
                doc, ids, start, total = held.pop()
                piece = ids[: want - at]
                self.emit(doc, piece, start, total, at)
                at += len(piece)
                if len(piece) < len(ids):
                    held.append((doc, ids[len(piece) :], start + len(piece), total))
            self.next_id += 1
        self.open_new()

    def emit(self, doc, ids, start, total, at) -> None:
        self.rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next_id, at))

    @staticmethod
    def loss_in(start: int, length: int, total: int, loss: int) -> int:
        """Loss-bearing tokens of a piece; they are the last ``loss`` of the document."""
        return max(0, start + length - max(start, total - loss))

    def add(self, doc, ids: np.ndarray, loss: int) -> None:
        total, cap, start = len(ids), int(min(self.room_of[0], self.room_of[2])), 0
        while total - start >= cap:  # whole sequences of one document
            if self.room_of[0] == cap:
                self.emit(doc, ids[start : start + cap], start, total, 0)
                self.next_id += 1
            else:
                self.wait(doc, ids[start : start + cap], start, total, loss)
            start += cap
        if start < total:
            self.wait(doc, ids[start:], start, total, loss)

    def wait(self, doc, ids, start, total, loss) -> None:
        while not self.free:
            self.step()
        k = self.free.pop()
        self.items[k] = (doc, ids, start, total, loss)
        self.demand[k] = len(ids), 1, self.loss_in(start, len(ids), total, loss)

    def step(self) -> None:
        """Put one more piece into the open sequence, or close it."""
        live = self.demand[:, 1] > 0
        fits = live & (self.demand <= self.room).all(1)
        if fits.any():
            score = np.where(fits, (self.demand / self.room_of) @ (self.room / self.room_of), -1.0)
            self.take(int(score.argmax()), None)
        elif self.room[1] >= 1 and self.room[0] >= 1 and self.room[2] >= 1 and live.any():
            k = int(np.where(live, self.demand[:, 0], -1).argmax())
            self.take(k, int(min(self.room[0], self.room[2], self.demand[k, 0])))
        else:
            self.close()
        if self.room.min() < 1:
            self.close()

    def take(self, k: int, length: int | None) -> None:
        doc, ids, start, total, loss = self.items[k]
        piece = ids if length is None else ids[:length]
        self.held.append((doc, piece, start, total))
        self.room -= len(piece), 1, self.loss_in(start, len(piece), total, loss)
        rest = ids[len(piece) :]
        if len(rest):
            self.items[k] = (doc, rest, start + len(piece), total, loss)
            self.demand[k] = len(rest), 1, self.loss_in(start + len(piece), len(rest), total, loss)
        else:
            self.items[k] = None
            self.demand[k] = 0
            self.free.append(k)

    def finish(self) -> None:
        """Empty the waiting set; the last sequence is closed as it is."""
        while (self.demand[:, 1] > 0).any():
            self.step()
        self.close()


def pack(docs: DataFrame, max_tokens: int = 2048, max_segments: int | None = None, max_loss: int | None = None, vocabulary: str | None = None) -> DataFrame:
    """docs(doc_id, text[, loss_tokens]) -> pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and an end id of 1; every id lies in exactly one piece. loss_tokens: how many of the last ids
    bear loss (the answer of an instruction; absent or null: all). No sequence exceeds max_tokens, max_segments or
    max_loss (default max_tokens, which is no further limit); one that these end early is cut into powers of two. Null text is an empty one: a document of the end id alone. Null doc_ids and repeated
    rows are packed like any other; other columns are ignored. An empty table gives no pieces. sequence_id is
    (partition, running number), so a task that runs again makes the same rows from the same split.
    """
    loss_limit = max_tokens if max_loss is None else max_loss
    segments = max_tokens if max_segments is None else max_segments
    if min(max_tokens, segments, loss_limit) < 1:
        raise ValueError("limits must be positive")
    loss = F.col("loss_tokens").cast("long") if "loss_tokens" in docs.columns else F.lit(None).cast("long")

    def run(batches: Batches) -> Batches:
        path = vocabulary or default_vocabulary("word_bpe_49k.json")
        packer = Packer(TaskContext.get().partitionId() << 36, max_tokens, segments, loss_limit)
        end = np.array([END_ID], "<u4").tobytes()

        def flush():
            rows, packer.rows = packer.rows, []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [()] * 7)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for rows in in_parts(batches, CHUNK):
            for doc, raw, bearing in zip(rows.column(0).to_pylist(), encode_rows(path, texts(rows.column(1))), rows.column(2).to_pylist()):
                ids = np.frombuffer(raw + end, "<u4")
                packer.add(doc, ids, len(ids) if bearing is None else min(max(0, bearing), len(ids)))
            yield flush()
        packer.finish()
        yield flush()

    return docs.select("doc_id", "text", loss.alias("loss_tokens")).mapInArrow(run, _SCHEMA)
