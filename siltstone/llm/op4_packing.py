"""Best-fit packing of token sequences.

Documents are tokenised once and cut into pieces of at most ``limit`` tokens. Which
pieces go together depends only on how many there are of each length, and
there are at most ``limit`` lengths: the histogram (a bounded table) goes to the
driver, best-fit decreasing runs over it with a segment tree over the remaining
capacities (the tightest open bin of the capacity needed in logarithmic time), equal pieces
at a time, and gives for each length a list of runs: from the piece of that rank on,
so many to a bin, in bins numbered from ``bin`` on, at this offset. The plan goes back to
all tasks, where a piece finds its place by its rank among the pieces of its length.
The result is the one that best-fit decreasing gives piece by piece.

Ranks need no global sort: a task numbers its own pieces of a length, and the tasks'
counts are summed up in order.

Defined results: null counts as empty, and an empty document is the end token alone;
repeated rows are packed each; null doc_ids are kept; very long texts are tokenised whole and cut into pieces; ties (pieces of one length) go by the task and the place in it,
so which of them gets which place may change with the layout, the number of sequences never; columns other than doc_id and text are not read and
not returned; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import extended, materialise, released, slices, utf8

#: Chunks of these characters only go the short way: lower case, split, merge, without
#: normalisation. (Letters that fold to two characters, spaces and control characters are not among them.)
PLAIN = re.compile("[!-~¡-įı-ž]+")
END = (1).to_bytes(4, "little")


class _Generations:
    """Values that were made lately."""

    def __init__(self, size: int) -> None:
        self.size, self.young, self.old = size, {}, {}

    def again(self, key) -> bytes | None:
        """An old value, young again."""
        value = self.old.get(key)
        if value is not None:
            self.keep(key, value)
        return value

    def keep(self, key, value: bytes) -> None:
        if len(self.young) >= self.size:
            self.old = dict(self.young)
            self.young.clear()  # the dict that readers hold stays the same
        self.young[key] = value


class CachedTokenizer:
    """ids of a text as little-endian bytes, equal to ``encode(text, add_special_tokens=False)``.

    This tokenizer drops white space and never merges across it, so a text's ids are its
    chunks' ids in order. Chunks and their letter runs are remembered in two generations: when the young one is full the old one goes, and what is
    met again becomes young, so frequent words stay.
    """

    def __init__(self, path: str, chunks: int = 400_000, pieces: int = 200_000) -> None:
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall  # the file's own pattern
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level alphabet: these bytes stand for themselves
        hidden = [b for b in range(256) if b not in set(shown)]
        self.alphabet = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.chunks, self.pieces = _Generations(chunks), _Generations(pieces)

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.young.get(piece) or self.pieces.again(piece)
        if ids is None:
            symbols = piece.encode().decode("latin-1").translate(self.alphabet)
            tokens = self.model.tokenize(symbols)
            ids = struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])
            self.pieces.keep(piece, ids)
        return ids

    def _chunk(self, chunk: bytes) -> bytes:
        if (ids := self.chunks.again(chunk)) is not None:
            return ids
        text = chunk.decode()
        if PLAIN.fullmatch(text) and "<|" not in text:
            ids = b"".join(map(self._piece, self.split(text.lower())))
        else:
            ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(chunk) <= 64:
            self.chunks.keep(chunk, ids)
        return ids

    def encode(self, text: bytes) -> bytes:
        out = []
        for part in range(0, len(chunks := text.split()), 50_000):
            get = self.chunks.young.get
            out += [get(c) or self._chunk(c) for c in chunks[part : part + 50_000]]
        return b"".join(out)


_loaded: dict[str, CachedTokenizer] = {}


def tokenizer_for(vocabulary: str, remembered: int) -> CachedTokenizer:
    """One a worker process; it outlives the task."""
    held = _loaded.get(vocabulary)
    if held is None or held.chunks.size != remembered:
        _loaded[vocabulary] = CachedTokenizer(vocabulary, remembered, remembered // 2)
    return _loaded[vocabulary]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def tokenise(docs: DataFrame, vocabulary: str, limit: int, remembered: int) -> DataFrame:
    """The pieces: doc_id, piece, start, length, ids (little-endian bytes), part and rank (the
    piece's number among those of its length in this task)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_for(vocabulary, remembered)
        part, ranks = TaskContext.get().partitionId(), {}
        for batch in slices(batches, "text", 2 << 20):
            at, rows = [], []
            for i, text in enumerate(utf8(batch.column("text"))):
                ids = tokenizer.encode(text or b"") + END
                for k, s in enumerate(range(0, len(ids), 4 * limit)):
                    piece = ids[s : s + 4 * limit]
                    n = len(piece) // 4
                    rank = ranks[n] = ranks.get(n, -1) + 1
                    at.append(i)
                    rows.append((k, s // 4, n, piece, part, rank))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "piece", "start", "length", "ids", "part", "rank"])

    schema = extended(docs.select("doc_id").schema, "piece int, start long, length long, ids binary, part int, rank long")
    return docs.select("doc_id", "text").mapInArrow(released(run), schema)


class Capacities:
    """A segment tree over the capacities 0..limit: how many kinds of open bins have each."""

    def __init__(self, limit: int) -> None:
        self.leaves = 1
        while self.leaves <= limit:
            self.leaves *= 2
        self.tree = [0] * (2 * self.leaves)

    def add(self, capacity: int, n: int) -> None:
        i = capacity + self.leaves
        while i:
            self.tree[i] += n
            i //= 2

    def tightest(self, needed: int) -> int | None:
        """The smallest capacity of at least ``needed`` that an open bin has."""
        i = needed + self.leaves
        if self.tree[i]:
            return needed
        while i > 1:
            if i % 2 == 0 and self.tree[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.tree[2 * i] else 2 * i + 1
                return i - self.leaves
            i //= 2
        return None


def best_fit_decreasing(counts: dict[int, int], limit: int) -> tuple[dict[int, list[tuple[int, int, int, int]]], int]:
    """For each length its runs (first rank, first bin, pieces to a bin, offset in the bin), and the number of bins.

    Equal pieces go together: the tightest bins that take a piece stay the tightest
    while they take more of that length, so each bin of a kind is filled before the next one.
    """
    tree, kinds = Capacities(limit), {}  # capacity -> [(first bin, bins)]
    runs, bins = {}, 0

    def opened(capacity: int, first: int, n: int) -> None:
        if n and capacity:
            kinds.setdefault(capacity, []).append((first, n))
            tree.add(capacity, 1)

    for length in sorted(counts, reverse=True):
        left, done, own = counts[length], 0, []
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                first, n, capacity = bins, -(-left // (limit // length)), limit
                bins += n
            else:
                first, n = kinds[capacity].pop()
                tree.add(capacity, -1)
            each = capacity // length
            full = min(n, left // each)
            rest = left - full * each if full < n else 0
            own.append((done, first, each, limit - capacity))
            opened(capacity - each * length, first, full)
            if rest:
                opened(capacity - rest * length, first + full, 1)
            opened(capacity, first + full + bool(rest), n - full - bool(rest))
            done += full * each + rest
            left -= full * each + rest
        runs[length] = own
    return runs, bins


def pack(docs: DataFrame, limit: int = 4096, vocabulary: str | None = None, keep_ids: bool = True, remembered: int = 400_000) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids or their CRC, sequence_id, offset. ``remembered``: chunks of a generation of a worker's cache,
    for speed against memory (400,000 take up to about 200 MB); no effect on the result."""
    pieces = tokenise(docs, vocabulary or default_vocabulary(), limit, remembered)
    if not keep_ids:
        pieces = _with_crc(pieces)
    pieces = materialise(pieces, "pieces")
    counts = materialise(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``limit`` rows
    runs, _ = best_fit_decreasing(histogram, limit)
    plan = {n: np.array(r, np.int64) for n, r in runs.items()}
    shared = docs.sparkSession.sparkContext.broadcast(plan)
    # the bases grow with the tasks, so they are never broadcast
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("part", "length", F.coalesce(before, F.lit(0)).alias("base"))
    ranked = pieces.join(bases.hint("merge"), ["part", "length"]).withColumn("rank", F.col("rank") + F.col("base"))
    content = "ids" if keep_ids else "ids_crc32"
    columns = ["doc_id", "piece", "start", "length", content, "rank"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for n in np.unique(lengths):
                of = np.flatnonzero(lengths == n)
                table = shared.value[int(n)]
                run = table[np.searchsorted(table[:, 0], ranks[of], "right") - 1]
                k = ranks[of] - run[:, 0]
                bins[of], offsets[of] = run[:, 1] + k // run[:, 2], run[:, 3] + k % run[:, 2] * n
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns[:-1]), pa.array(bins), pa.array(offsets)], names=[*columns[:-1], "sequence_id", "offset"])

    schema = extended(ranked.select(columns[:-1]).schema, "sequence_id long, offset long")
    return ranked.select(columns).mapInArrow(released(place), schema)


def _with_crc(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "part", "rank")
