"""LM scoring by cross-entropy difference.

A target model (from ``target``'s texts) and a background model (from all documents) are word n-gram models of the same form and
smoothing over one shared vocabulary: every word of both, and a token for a
text's boundary; V tokens in all. A text is read as a ring that starts and ends at the boundary, so each token is predicted once and is a context once. A
token's loss is the weighted mean of its losses in a bigram and a unigram model, each of which sums to 1 over the vocabulary:

    P2(b | a) = (count(ab) + m / V) / (count(a) + m),   P1(b) = (count(b) + 1) / (total + V)

A text's loss is then a sum over its words (of what depends on ``count(a)``) and over its pairs (of ``log(count(ab) + m / V)``). A
document's score is its mean background loss less its mean target loss: higher is more like the target.

All counts cover every word and pair of every text. Words are told apart by 64-bit hashes, keys in a bucket by ``PLACE_BITS`` bits more (a count
includes another's with a chance of about 4e-6). Counts grow with the corpus and stay
distributed: a key's first bits are its bucket, so no frequent word or pair makes a bucket's table large, and there are as many buckets
as it takes for ``bucket_tokens`` tokens each. The counts of the ``frequent`` most frequent words are also sent to all tasks: their share of the losses is
added where the text is read. That saves rows and changes no score.

1.  Each block of texts sends one row a bucket with its pairs' counts; a task adds a bucket's rows up.
2.  Each block of documents sends one row a bucket with its (key, document, count) entries, of pairs and of rarer words. They meet the bucket's counts in one sorted
    stream; what comes back is a sum for each document of the block. Only the bucket's counts are held.
3.  A block's sums, sorted by block, are added to its documents.

Losses are added as integers (units of ``1 / UNIT``), so the result doesn't depend on partitions or on the order of rows. Blocks are
numbered by partition and place, so ``docs`` must be a table that is read: the result of a join, an aggregate or a shuffle is written first.

Defined results: null and word-less texts have no words and the score 0; rows that repeat count and are scored each; an empty target or
corpus leaves smoothing only; null doc_ids are kept; very long texts are read whole, each in a block of its own; ties (words that are equally frequent at the end of
``frequent``) don't change a score; columns other than doc_id and text are not read and not returned; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import extended, materialise, slices, utf8
from .op2_decontaminate import words_of

UNIT = 1 << 20
BOUNDARY = 0
#: Of a key, besides its bucket's: with at most about 2 ** 22 keys in a bucket, a key is taken for another with a chance of 2 ** -18.
PLACE_BITS = 40
#: Rows that meet in a bucket, in this order: counts of pairs in both models and of words, then entries of documents.
BACKGROUND, TARGET, WORDS, PAIR_ENTRIES, WORD_ENTRIES = range(5)


@dataclass(frozen=True)
class LMParams:
    frequent: int = 1 << 16  #: words whose counts are sent to all tasks
    bucket_tokens: int = 1 << 22
    smoothing: float = 8.0  #: m
    bigram: float = 0.5  #: weight of the bigram model's loss
    block_bytes: int = 8 << 20


class _Cache(dict):
    """Numbers of words, kept up to a bound."""

    def __init__(self, number: Callable[[bytes], int]) -> None:
        self.number = number

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        n = self[word] = self.number(word)
        return n


def word_hash(word: bytes) -> int:
    """64 bits, signed; 0 is the boundary's."""
    h = xxhash.xxh64_intdigest(word)
    return (h - (1 << 64) if h >> 63 else h) or 1


def blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches of about ``size`` bytes of text and fewer than 2 ** 16 rows."""
    for batch in slices(batches, "text", size):
        for s in range(0, batch.num_rows, 60_000):
            yield batch.slice(s, 60_000)


def rings(texts: list[bytes | None], numbers: _Cache) -> tuple[np.ndarray, np.ndarray]:
    """The tokens (hashes) of all texts, each text led by its boundary, and each text's number of tokens (0 without words)."""
    parts, sizes = [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        if words := words_of(text):
            sizes[i] = len(words) + 1
            parts += [np.array([BOUNDARY]), np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64), sizes


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and their sums."""
    if not len(keys):
        return keys, n
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
    return keys[starts], np.add.reduceat(n[order], starts)


@dataclass(frozen=True)
class Vocabulary:
    """What all tasks know: the size and totals, and the frequent words' counts."""

    size: int
    totals: tuple[int, int]  #: of background and target
    hashes: np.ndarray  #: sorted; the boundary is among them
    counts: tuple[np.ndarray, np.ndarray]
    bits: int  #: 2 ** bits buckets

    def word_losses(self, counts: np.ndarray, model: int, p: LMParams) -> np.ndarray:
        """The part of a loss that depends on one word, in units."""
        single = -np.log((counts + 1) / (self.totals[model] + self.size))
        return np.rint(UNIT * ((1 - p.bigram) * single + p.bigram * np.log(counts + p.smoothing))).astype(np.int64)

    def pair_losses(self, counts: np.ndarray, p: LMParams) -> np.ndarray:
        return np.rint(-UNIT * p.bigram * np.log(counts + p.smoothing / self.size)).astype(np.int64)

    def places(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where tokens stand among the frequent words, and whether they do."""
        at = np.minimum(np.searchsorted(self.hashes, tokens), len(self.hashes) - 1)
        return at, self.hashes[at] == tokens


def word_counts(docs: DataFrame, target: DataFrame, p: LMParams) -> DataFrame:
    """word (its hash), b and t: its counts in the documents and in the target."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _Cache(word_hash)
        for batch in blocks(batches, p.block_bytes):
            found, n = np.unique(rings(utf8(batch.column("text")), numbers)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n, pa.int64())], names=["word", "n"])

    def counted(texts: DataFrame) -> DataFrame:
        return texts.select("text").mapInArrow(run, "word long, n long")

    zero = F.lit(0).cast("long")
    both = counted(docs).select("word", F.col("n").alias("b"), zero.alias("t")).union(counted(target).select("word", zero, "n"))
    return materialise(both.groupBy("word").agg(F.sum("b").alias("b"), F.sum("t").alias("t")), "words")


def vocabulary(words: DataFrame, p: LMParams) -> Vocabulary:
    size, b, t = words.agg(F.count("*"), F.coalesce(F.sum("b"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    top = words.orderBy(F.col("word") == BOUNDARY, (F.col("b") + F.col("t")).desc(), "word").limit(p.frequent)
    top = top.union(words.where(F.col("word") == BOUNDARY)).distinct().toPandas().sort_values("word")  # at most ``frequent`` + 1 rows
    if top.empty:
        top.loc[0] = [BOUNDARY, 0, 0]
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = (max(4 * parts, (b + t) // p.bucket_tokens) - 1).bit_length()
    columns = [top[c].to_numpy(np.int64) for c in ("word", "b", "t")]
    return Vocabulary(size, (b, t), columns[0], (columns[1], columns[2]), min(bits, 24))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def pair_keys(tokens: np.ndarray) -> np.ndarray:
    """Each token with the one after it, hashed to 64 bits."""
    after = np.append(tokens[1:], BOUNDARY)  # each ring starts at the boundary, where the one before it ends
    return _mixed(_mixed(tokens.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + after.astype(np.uint64))


def word_keys(tokens: np.ndarray) -> np.ndarray:
    return _mixed(tokens.astype(np.uint64) ^ np.uint64(0xA5A5A5A5A5A5A5A5))


def _cut(keys: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """The buckets in sorted ``keys``."""
    of = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    cuts = np.concatenate([[0], np.flatnonzero(of[1:] != of[:-1]) + 1, [len(of)]])
    for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if e > s:
            yield int(of[s]), slice(s, e)


def _places(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``PLACE_BITS`` bits after the bucket's, in two parts."""
    place = (keys << np.uint64(bits)) >> np.uint64(64 - PLACE_BITS)
    return place.astype("<u4"), (place >> np.uint64(32)).astype("u1")


def _place(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return low + (high.astype(np.int64) << 32)


def _pack(*columns: np.ndarray) -> bytes:
    return b"".join(c.tobytes() for c in columns)


def _unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    kinds = [np.dtype(k) for k in kinds]
    n, at, out = len(blob) // sum(k.itemsize for k in kinds), 0, []
    for k in kinds:
        out.append(np.frombuffer(blob, k, n, at))
        at += n * k.itemsize
    return out


def pair_counts(texts: DataFrame, model: int, bits: int, p: LMParams) -> DataFrame:
    """bucket, kind (the model) and blob (places and their counts, sorted; several rows for a large bucket)."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _Cache(word_hash)
        for batch in blocks(batches, p.block_bytes):
            keys, n = np.unique(pair_keys(rings(utf8(batch.column("text")), numbers)[0]), return_counts=True)
            low, high = _places(keys, bits)
            rows = [(bucket, _pack(low[s], high[s], n[s].astype("<u4"))) for bucket, s in _cut(keys, bits)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int32()), pa.array([x[1] for x in rows], pa.binary())], names=["bucket", "blob"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, rows = None, [], 0

        def done() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            place, n = _summed(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))
            for s in range(0, len(place), 100_000):
                part = place[s : s + 100_000]
                blob = _pack(part.astype("<u4"), (part >> 32).astype("u1"), n[s : s + 100_000].astype("<i8"))
                yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([model], pa.int32()), pa.array([blob], pa.binary())], names=["bucket", "kind", "blob"])
            held.clear()

        for batch in batches:
            for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                if bucket != now:
                    yield from done()
                    now, rows = bucket, 0
                low, high, n = _unpack(blob, "<u4", "u1", "<u4")
                held.append((_place(low, high), n.astype(np.int64)))
                rows += len(low)
                if rows > 4_000_000:  # frequent pairs come from every block: add up what is there
                    held[:] = [_summed(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))]
                    rows = 0
        yield from done()

    sent = texts.select("text").mapInArrow(send, "bucket int, blob binary")
    return sent.repartition(F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(add, "bucket int, kind int, blob binary")


def rare_words(words: DataFrame, shared) -> DataFrame:
    """bucket, kind (WORDS) and blob (places and both counts) of the words that aren't sent to all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in batches:
            word, b, t = (batch.column(c).to_numpy() for c in ("word", "b", "t"))
            rare = ~v.places(word)[1]
            keys = word_keys(word[rare])
            order = np.argsort(keys)
            keys, b, t = keys[order], b[rare][order], t[rare][order]
            low, high = _places(keys, v.bits)
            rows = [(bucket, WORDS, _pack(low[s], high[s], b[s].astype("<i8"), t[s].astype("<i8"))) for bucket, s in _cut(keys, v.bits)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["bucket", "kind", "blob"])

    return words.select("word", "b", "t").mapInArrow(run, "bucket int, kind int, blob binary")


def _around(docs: DataFrame, before: str) -> StructType:
    """The columns ``before``, the documents' ids as they are, and what a row carries."""
    return StructType([*StructType.fromDDL(before), *docs.select("doc_id").schema, *StructType.fromDDL("tokens long, b long, t long, blob binary")])


def _entries(docs: DataFrame, shared, p: LMParams) -> DataFrame:
    """Rows of the two kinds of entries: a block's in a bucket (idx null), and a row for each document with its frequent words' losses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, v = _Cache(word_hash), shared.value
        losses = [v.word_losses(c, m, p) for m, c in enumerate(v.counts)]
        partition = TaskContext.get().partitionId()
        block, turn = partition << 32, partition * 977
        names = ["bucket", "kind", "block", "idx", "doc_id", "tokens", "b", "t", "blob"]

        def rows_of(keys: np.ndarray, doc: np.ndarray, kind: int) -> list[tuple[int, int, bytes]]:
            order = np.argsort(keys, kind="stable")  # documents stay in order
            keys, doc = keys[order], doc[order]
            starts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])) + 1]) if len(keys) else np.zeros(0, np.int64)
            n = np.diff(np.append(starts, len(keys)))
            times = -(-n // 255)
            last = np.cumsum(times) - 1
            keys, doc, n_ = np.repeat(keys[starts], times), np.repeat(doc[starts], times).astype("<u2"), np.full(int(times.sum()), 255, np.int64)  # an entry counts to 255
            n_[last] = n - 255 * (times - 1)
            low, high = _places(keys, v.bits)
            n_ = n_.astype("u1")
            return [(bucket, kind, _pack(low[s], high[s], doc[s], n_[s])) for bucket, s in _cut(keys, v.bits)]

        for batch in blocks(batches, p.block_bytes // 2):
            m = batch.num_rows
            tokens, sizes = rings(utf8(batch.column("text")), numbers)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            at, known = v.places(tokens)
            sums = [np.diff(np.concatenate([[0], np.cumsum(np.where(known, x[at], 0))])[ends]) for x in losses]
            where = (turn + np.arange(m) // 200) % (1 << v.bits)  # any bucket: spread
            fixed = [where.astype(np.int32), np.full(m, PAIR_ENTRIES, np.int32), np.full(m, block), np.arange(m, dtype=np.int32)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, fixed), batch.column("doc_id"), *map(pa.array, (sizes, *sums)), pa.nulls(m, pa.binary())], names=names)
            doc = np.repeat(np.arange(m, dtype=np.int32), sizes)
            rows = rows_of(pair_keys(tokens), doc, PAIR_ENTRIES) + rows_of(word_keys(tokens[~known]), doc[~known], WORD_ENTRIES)
            k = len(rows)
            fixed = [np.array([x[i] for x in rows], np.int32) for i in (0, 1)] + [np.full(k, block)]
            empty = [pa.nulls(k, c) for c in (pa.int32(), batch.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*map(pa.array, fixed), *empty, pa.array([x[2] for x in rows], pa.binary())], names=names)
            block, turn = block + 1, turn + m // 200 + 1

    return docs.select("doc_id", "text").mapInArrow(run, _around(docs, "bucket int, kind int, block long, idx int"))


class _Table:
    """A bucket's sorted places with values; 0 for others."""

    def __init__(self) -> None:
        self.parts: list[list[np.ndarray]] = []

    def add(self, place: np.ndarray, *values: np.ndarray) -> None:
        self.parts.append([place, *values])

    def get(self, place: np.ndarray, n: int = 1) -> list[np.ndarray]:
        if not self.parts:
            return [np.zeros(len(place), np.int64)] * n
        if len(self.parts) > 1 or not (self.parts[0][0][1:] >= self.parts[0][0][:-1]).all():
            columns = [np.concatenate(c) for c in zip(*self.parts, strict=True)]
            order = np.argsort(columns[0], kind="stable")
            self.parts = [[c[order] for c in columns]]
        known, *values = self.parts[0]
        at = np.minimum(np.searchsorted(known, place), len(known) - 1)
        hit = known[at] == place
        return [np.where(hit, x[at], 0) for x in values]


def _look_up(shared, p: LMParams, bound: int = 64 << 20):
    """Rows of the documents as they are; for each block a row with the sums of its documents' entries (a bucket's, or several buckets' as
    long as the sums of all blocks at hand take less than ``bound``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, tables, now = shared.value, [_Table() for _ in range(3)], None
        sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        held, kind_of_id = 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            ids, blobs = [], []
            for block, (b, t) in sums.items():
                used = np.flatnonzero((b != 0) | (t != 0))
                ids.append(block)
                blobs.append(_pack(used.astype("<u2"), b[used], t[used]))
            k = len(ids)
            empty = [pa.nulls(k, c) for c in (pa.int32(), kind_of_id, pa.int64(), pa.int64(), pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *empty, pa.array(blobs, pa.binary())], names=["block", "idx", "doc_id", "tokens", "b", "t", "blob"])
            sums.clear()

        for batch in batches:
            kind_of_id = batch.schema.field("doc_id").type
            texts = batch.filter(batch.column("idx").is_valid())
            if texts.num_rows:
                yield texts.select(["block", "idx", "doc_id", "tokens", "b", "t", "blob"])
            rest = batch.filter(batch.column("idx").is_null())
            for bucket, kind, block, blob in zip(*(rest.column(c).to_pylist() for c in ("bucket", "kind", "block", "blob")), strict=True):
                if bucket != now:
                    tables, now = [_Table() for _ in range(3)], bucket
                if kind == WORDS:
                    low, high, b, t = _unpack(blob, "<u4", "u1", "<i8", "<i8")
                    tables[kind].add(_place(low, high), b, t)
                    continue
                if kind < WORDS:
                    low, high, n = _unpack(blob, "<u4", "u1", "<i8")
                    tables[kind].add(_place(low, high), n)
                    continue
                low, high, doc, n = _unpack(blob, "<u4", "u1", "<u2", "u1")
                place, n = _place(low, high), n.astype(np.int64)
                if kind == PAIR_ENTRIES:
                    more = [v.pair_losses(tables[m].get(place)[0], p) for m in (BACKGROUND, TARGET)]
                else:
                    more = [v.word_losses(c, m, p) for m, c in enumerate(tables[WORDS].get(place, 2))]
                size = int(doc.max()) + 1
                b, t = sums.get(block, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                if len(b) < size:
                    held += 16 * (size - len(b))
                    b, t = (np.concatenate([x, np.zeros(size - len(x), np.int64)]) for x in (b, t))
                np.add.at(b, doc, n * more[0])
                np.add.at(t, doc, n * more[1])
                sums[block] = b, t
                if held > bound:
                    yield from flush()
                    held = 0
        if sums:
            yield from flush()

    return run


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block and idx, so a block's sums come before its documents."""
    now, b, t = None, None, None
    for batch in batches:
        idx, ids = batch.column("idx"), batch.column("block").to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(ids[1:] != ids[:-1]) + 1, [len(ids)]])
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if s == e:
                continue
            if ids[s] != now:
                now, b, t = ids[s], np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
            part = batch.slice(s, e - s)
            for blob in part.column("blob").drop_null().to_pylist():
                doc, more_b, more_t = _unpack(blob, "<u2", "<i8", "<i8")
                b[doc] += more_b
                t[doc] += more_t
            part = part.filter(idx.slice(s, e - s).is_valid())
            at, tokens, own_b, own_t = (part.column(c).to_numpy() for c in ("idx", "tokens", "b", "t"))
            size = np.maximum(tokens, 1) * UNIT
            background, target = (own_b + b[at]) / size, (own_t + t[at]) / size
            columns = [np.maximum(tokens - 1, 0), target, background, background - target]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, columns)], names=["doc_id", "n_words", "target_loss", "background_loss", "score"])


def _is_read(docs: DataFrame) -> bool:
    """Whether the rows come from files or constants, in the same order each time."""
    return not re.search(r"Exchange|ExistingRDD|Join|Aggregate|Sort|Window|InArrow|InPandas|Generate|Sample", docs._jdf.queryExecution().executedPlan().toString())


def score(docs: DataFrame, target: DataFrame, p: LMParams = LMParams()) -> DataFrame:
    """doc_id, n_words, target_loss, background_loss (means over the words and the boundary) and score of each row of ``docs`` (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    docs = docs if _is_read(docs) else materialise(docs, "documents")
    words = word_counts(docs, target, p)
    known = vocabulary(words, p)
    shared = docs.sparkSession.sparkContext.broadcast(known)
    counts = pair_counts(docs, BACKGROUND, known.bits, p).union(pair_counts(target, TARGET, known.bits, p)).union(rare_words(words, shared))
    rows = _entries(docs, shared, p).unionByName(counts, allowMissingColumns=True)
    sorted_ = rows.repartition(F.col("bucket")).sortWithinPartitions("bucket", "kind")
    sums = sorted_.mapInArrow(_look_up(shared, p), _around(docs, "block long, idx int"))
    by_block = sums.repartition(F.col("block")).sortWithinPartitions("block", F.col("idx").asc_nulls_first())
    return by_block.mapInArrow(_finish, extended(docs.select("doc_id").schema, "n_words long, target_loss double, background_loss double, score double"))
