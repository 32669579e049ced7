"""Benchmark decontamination: a broadcast hash set of normalised test windows.

Every benchmark item gives windows of ``window`` consecutive words (an item of
fewer words is one window). The windows' hashes, sorted by window length, are
sent to every task; there each document's words are numbered in the benchmark's
vocabulary, the window hashes come from one rolling polynomial over the batch,
and every hit is verified word by word before its words are marked.

The set's size is checked: at most ``max_windows`` windows go out at once. A
larger benchmark is taken in blocks, an item with more windows than a block in
overlapping parts; each block is a pass of its own over what the one before it
wrote, so a task holds one block, and their marks are united row by row, so the result doesn't change.

Defined results: null or word-less texts have no words, no hits and the digest
of the empty string; items without an id or without words take no part; rows that
repeat an item_id are one item; documents that repeat are each reported; ties don't arise; very long texts are read
whole, a text at a time; null doc_ids stay; other columns stay as they are, but for those named in ``ADDED`` and ``contaminated``, which are
replaced; an empty table gives an empty result, an empty benchmark no hits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extended, materialise, released, slices, utf8

#: Everything that isn't a word byte becomes a space; A-Z become a-z.
NORMAL = bytes((c | 32 if 65 <= c <= 90 else c) if c > 127 or chr(c).isalnum() else 32 for c in range(256))
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(NORMAL).split() if text else []


class Windows:
    """The hash set: the vocabulary, and for each window length the sorted window hashes,
    each with its word numbers and the items that have it."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.whole: dict[object, set[bytes]] = {}  # of items that are a window or more
        found: dict[int, dict[tuple[int, ...], set]] = {}
        for item, words in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            n = min(window, len(ids))
            if n == window:
                self.whole.setdefault(item, set()).add(b" %b " % b" ".join(words))
            for i in range(len(ids) - n + 1):
                found.setdefault(n, {}).setdefault(tuple(ids[i : i + n]), set()).add(item)
        self.tables = []
        for n, table in sorted(found.items()):
            grams = np.array(list(table), np.int64)
            h = _hashes(grams)
            order = np.argsort(h, kind="stable")
            owners = [table[tuple(g)] for g in grams[order].tolist()]
            self.tables.append((n, h[order], grams[order], owners))

    def scan(self, texts: list[list[bytes]]) -> list[tuple[np.ndarray, set]]:
        """For each text: which of its words are hit, and the items with occurring windows."""
        sizes = np.array([len(t) for t in texts], np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        get = self.vocabulary.get
        flat = np.fromiter((get(w, -1) for t in texts for w in t), np.int64, int(starts[-1]))
        ends = np.repeat(starts[1:], sizes)
        unknown = np.concatenate([[0], np.cumsum(flat < 0)])
        hit, items = np.zeros(len(flat) + 1, np.int64), [set() for _ in texts]
        for n, table, grams, owners in self.tables:
            at = np.arange(max(len(flat) - n + 1, 0))
            at = at[(ends[at] - at >= n) & (unknown[at + n] == unknown[at])]
            if not len(at):
                continue
            h = _hashes(np.lib.stride_tricks.sliding_window_view(flat, n)[at])
            first, last = np.searchsorted(table, h, "left"), np.searchsorted(table, h, "right")
            for k in np.flatnonzero(last > first):
                i = int(at[k])
                for j in range(first[k], last[k]):
                    if (grams[j] == flat[i : i + n]).all():
                        hit[i] += 1
                        hit[i + n] -= 1
                        items[int(np.searchsorted(starts, i, "right")) - 1] |= owners[j]
        marked = np.cumsum(hit[:-1]) > 0
        # hit[i + n] may fall on the next text's first word, where the sum is back at its old value
        return [(marked[s:e], x) for s, e, x in zip(starts[:-1], starts[1:], items, strict=True)]


    def holds_whole(self, text: list[bytes], items: set) -> bool:
        """Whether one of the items, of ``window`` words or more, is in the text from its first word to its last."""
        wanted = [x for i in items for x in self.whole.get(i, ())]
        joined = b" %b " % b" ".join(text) if wanted else b""
        return any(x in joined for x in wanted)


def _hashes(grams: np.ndarray) -> np.ndarray:
    h = np.zeros(len(grams), np.uint64)
    for j in range(grams.shape[1]):
        h = h * BASE + grams[:, j].astype(np.uint64) + np.uint64(1)
    return h


def _blocks(benchmark: DataFrame, window: int, max_windows: int) -> Iterator[Windows]:
    """Blocks of at most ``max_windows`` windows; streamed, so the driver holds one at a time."""
    items, held = [], 0
    for row in benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text").toLocalIterator():
        words = words_of(row.text.encode())
        for s in range(0, max(len(words) - window + 1, min(len(words), 1)), max_windows):
            part = words[s : s + max_windows + window - 1]
            n = max(len(part) - window + 1, 1)
            if items and held + n > max_windows:
                yield Windows(items, window)
                items, held = [], 0
            items.append((str(row.item_id), part))
            held += n
    if items:
        yield Windows(items, window)


ADDED = {"hit": "binary", "items": "array<string>", "n_words": "long", "n_hit": "long", "whole": "boolean"}


def _scan(docs: DataFrame, windows: Windows, cut: bool) -> DataFrame:
    """Adds the columns, or unites them with those of the blocks scanned before; ``cut``: hit words' bytes are taken out of the texts."""
    shared = docs.sparkSession.sparkContext.broadcast(windows)
    again = "hit" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in slices(batches, "text", 4 << 20):
            texts = [words_of(t) for t in utf8(batch.column("text"))]
            got = w.scan(texts)
            marks = [m for m, _ in got]
            items = [x for _, x in got]
            whole = [bool(x) and w.holds_whole(t, x) for t, x in zip(texts, items, strict=True)]
            if again:
                whole = [x or b for x, b in zip(whole, batch.column("whole").to_pylist(), strict=True)]
                before = [np.unpackbits(np.frombuffer(b, np.uint8), count=len(t)).astype(bool) if b else False for b, t in zip(batch.column("hit").to_pylist(), texts, strict=True)]
                marks = [m | b for m, b in zip(marks, before, strict=True)]
                items = [x | set(b) for x, b in zip(items, batch.column("items").to_pylist(), strict=True)]
            columns = dict(zip(batch.schema.names, batch.columns, strict=True)) | {
                "hit": pa.array([np.packbits(m).tobytes() if m.any() else b"" for m in marks], pa.binary()),
                "items": pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                "n_words": pa.array([len(t) for t in texts], pa.int64()),
                "n_hit": pa.array([int(m.sum()) for m in marks], pa.int64()),
                "whole": pa.array(whole, pa.bool_()),
            }
            if cut:
                columns["text"] = pa.array([t if t is None else _without(t, m).decode() if m.any() else t.decode() for t, m in zip(utf8(batch.column("text")), marks, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    schema = docs.schema if again else extended(docs.schema, ", ".join(map(" ".join, ADDED.items())))
    return docs.mapInArrow(released(run), schema)


def find(docs: DataFrame, benchmark: DataFrame, window: int = 13, max_windows: int = 1_000_000, cut: bool = False) -> DataFrame:
    """``docs`` with ``hit`` (a bit for each word, empty without hits), ``items`` (ids as strings,
    sorted), ``n_words``, ``n_hit`` and ``whole`` (an item of ``window`` words or more, or a block's part of it, is there as a whole). Columns of these names are replaced.
    ``cut``: the hit words are taken out of the texts (words keep their case elsewhere); the columns still tell of the text before that."""
    docs = docs.drop(*ADDED, "contaminated")
    blocks = _blocks(benchmark, window, max_windows)
    out, windows = docs, next(blocks, None) or Windows([], window)
    for after in blocks:
        out, windows = materialise(_scan(out, windows, False), "scanned"), after
    out = _scan(out, windows, cut)
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query."""
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


def _without(text: bytes, marked: np.ndarray) -> bytes:
    out, at = [], 0
    for m, gone in zip(WORD.finditer(text), marked, strict=True):
        if gone:
            out.append(text[at : m.start()])
            at = m.end()
    return b"".join([*out, text[at:]])
