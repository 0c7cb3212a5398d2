"""Packing: best-fit decreasing with a segment tree indexed by remaining capacity."""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, small_batches, store, texts

WINDOW = 2048
END_ID = 1
#: Pieces shorter than a window that a task holds before it packs and releases them.
PENDING = 1_000_000
#: Share of a window from which its pieces stay in it in the second round.
FILLED = 0.99
#: White-space characters in a row from which a text takes the slower reader.
LONG_RUN = 100_000
BLANK_RUN = re.compile(rf"\s{{{LONG_RUN}}}")
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class CapacityTree:
    """Segment tree over remaining capacities 0..window: finds the tightest open window that holds a piece."""

    def __init__(self, window: int):
        self.leaves = 1
        while self.leaves <= window:
            self.leaves *= 2
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def _change(self, capacity: int, by: int) -> None:
        i = capacity + self.leaves
        while i:
            self.count[i] += by
            i >>= 1

    def add(self, capacity: int, sequence: int) -> None:
        self.open[capacity].append(sequence)
        self._change(capacity, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """Removes a window of the smallest remaining capacity that is at least `least`."""
        i = least + self.leaves
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        capacity = i - self.leaves
        self._change(capacity, -1)
        return capacity, self.open[capacity].pop()


def best_fit_decreasing(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece; pieces of one length go in their given order."""
    order = np.argsort(-lengths, kind="stable")
    sequence, offset = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    tree, used = CapacityTree(window), 0
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        found = tree.take(n)
        capacity, s = found or (window, used)
        used += found is None
        sequence[i], offset[i] = s, window - capacity
        if capacity > n:
            tree.add(capacity - n, s)
    return sequence, offset


def load_encoder(vocabulary: str | None = None):
    """encode(text) -> ids, equal to the `tokenizers` file byte_bpe_50k.json without special tokens added.

    The same merges are read as ranks, which encode several times faster; the one special string is cut out and gets
    its id, as the tokenizer does. The fast reader's pattern overflows its stack on very long runs of white space, so
    texts with one go to `tokenizers` itself. `vocabulary` is the path of the .tiktoken file, beside the .json one.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    path = str(vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    slow: list[Tokenizer] = []
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    special = "<|endoftext|>"
    encoding = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if len(text) >= LONG_RUN and BLANK_RUN.search(text):
            if not slow:
                slow.append(Tokenizer.from_file(path.removesuffix(".tiktoken") + ".json"))
            return np.asarray(slow[0].encode(text, add_special_tokens=False).ids, dtype="<u4")
        if special not in text:
            return np.asarray(encoding.encode_ordinary(text), dtype="<u4")
        out: list[int] = []
        for k, part in enumerate(text.split(special)):
            out += [50256] * bool(k) + encoding.encode_ordinary(part)
        return np.asarray(out, dtype="<u4")

    return encode


def pieces_of(ids: np.ndarray, window: int = WINDOW) -> Iterator[tuple[int, int, int]]:
    """(start, length, crc32) of an overlong document's full windows and its rest."""
    for start in range(0, len(ids), window):
        part = ids[start : start + window]
        yield start, len(part), zlib.crc32(part.tobytes())


def best_fit_by_counts(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts of pieces by length, all of a length that find the same room at once.

    Gives (length, first piece, pieces, host's length, first host, offset): pieces are numbered from 0 within their
    length, a window is known by the piece that opened it, and so many pieces and hosts from the first on are matched
    one to one.
    """
    tree, groups, out = CapacityTree(window), [], []
    for length in sorted(counts, reverse=True):
        at, left = 0, counts[length]
        while left:
            found = tree.take(length)
            if found is None:  # as many windows as hold the others of this length
                n, room = -(-left // (window // length)), window
                host = (length, at, n)
            else:
                room, (of, first, hosts) = found[0], groups[found[1]]
                n = min(left, hosts)
                host = (of, first, n)
                if hosts > n:
                    groups.append((of, first + n, hosts - n))
                    tree.add(room, len(groups) - 1)
            out.append((length, at, n, host[0], host[1], window - room))
            if room > length:
                groups.append(host)
                tree.add(room - length, len(groups) - 1)
            at, left = at + n, left - n
    return out


def packed_again(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """`pieces` with those of windows that are filled to less than FILLED packed anew among themselves.

    `pieces` must be a written table. Tasks leave few such windows, unless they are small. The driver gets counts by
    length (at most `window` of them) and makes the plan; pieces take their places by their rank within their length.
    """
    spark = pieces.sparkSession
    used = pieces.groupBy("sequence_id").agg(F.sum("length").alias("_used"))
    poor = store(used.where(F.col("_used") < FILLED * window).select(F.col("sequence_id").alias("_poor")), "pack-poor")
    n = poor.count()
    if n < 2:
        return pieces
    loose = store(pieces.join(poor, F.col("sequence_id") == F.col("_poor"), "left_semi"), "pack-loose", n)
    counts = {r["length"]: r["n"] for r in loose.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = spark.createDataFrame(best_fit_by_counts(counts, window), "_length long, _at long, _n long, _host long, _first long, _offset long")
    order = [F.xxhash64("sequence_id", "offset"), F.col("sequence_id"), F.col("offset")]
    ranked = numbered(loose.withColumn("_u", order[0]), ["length"], [F.col("_u"), *order[1:]], sum(counts.values()), "_rank")
    same = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_at")) & (F.col("_rank") < F.col("_at") + F.col("_n"))
    # a window's number: its host's length and place, above all numbers that tasks give
    number = F.lit(1 << 62) + F.shiftleft("_host", 44) + F.col("_first") + F.col("_rank") - F.col("_at")
    placed = ranked.join(F.broadcast(plan), same).withColumns({"sequence_id": number, "offset": F.col("_offset")})
    stay = pieces.join(poor, F.col("sequence_id") == F.col("_poor"), "left_anti")
    return stay.union(placed.select(*pieces.columns))


def pack(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW, pending: int = PENDING) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and then END_ID; null text is empty and so is the end id alone; texts of any length are read
    whole. Full windows are cut off first and are sequences of their own. The rests (under a window each) are packed by
    best-fit decreasing within the task that tokenized them, so no text is shuffled and no key can be hot; a task holds
    `pending` rests at most and then packs them. The pieces of windows that tasks leave badly filled are then packed
    again, together (see packed_again()), so that small files and blocks cost no padding. sequence_id is (partition,
    window in it) in one long. The outcome depends only on the rows and how they are split into tasks, so a repeated task gives the same
    rows. Repeated rows are packed again; columns other than doc_id and text are not read; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, next_id = load_encoder(vocabulary), TaskContext.get().partitionId() << 40
        held: list[tuple] = []

        def out(rows: np.ndarray | list, sequence, offset) -> pa.RecordBatch:
            columns = list(zip(*rows)) if len(rows) else [[]] * 5
            return pa.record_batch([pa.array(c, pa.int64()) for c in (*columns, sequence, offset)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal next_id, held
            if held:
                sequence, offset = best_fit_decreasing(np.asarray([r[2] for r in held]), window)
                for k in range(0, len(held), 50_000):
                    yield out(held[k : k + 50_000], sequence[k : k + 50_000] + next_id, offset[k : k + 50_000])
                next_id += int(sequence.max()) + 1
                held = []

        for batch in batches:
            full: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch, "text")):
                ids = np.append(encode(text), np.uint32(END_ID)).astype("<u4")
                for start, length, crc in pieces_of(ids, window):
                    (full if length == window else held).append((doc_id, start, length, crc, len(ids)))
            if full:
                yield out(full, np.arange(next_id, next_id + len(full)), np.zeros(len(full), dtype=np.int64))
                next_id += len(full)
            if len(held) >= pending:
                yield from flush()
        yield from flush()

    pieces = store(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA), "pack-pieces")
    return packed_again(pieces, window)
