"""Quality classifier: a second-order factorisation machine over hashed words,
structure statistics and the declared length.

    score(x) = sigmoid(b + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i (v_if x_i)^2])

The pairwise part is the sum-of-squares identity, so a document costs
``O(distinct features * rank)``. The model is fitted on a bounded sample of
labelled rows (``FMParams.sample``, the one bound here) and is of fixed size
(``dims * (rank + 1)`` floats), so it may be shipped to every task; every row is
then scored over its whole text by a narrow map, without a shuffle.

Defined results: a null text counts as empty; an empty text has only its
structure features and gets a score like any other; a null ``doc_id`` is kept
(``held_out`` false) and never trains; repeated rows are each scored, and of those with labels one of an id trains; very long texts are read whole; a null
``n_chars`` is a bin of its own; ties don't arise; an empty table gives an empty result; several labels of a
document are averaged and rounded (half up); with one class or none among the labels the
score is that class' smoothed share everywhere.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import extended, released, slices, utf8

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
MARK = re.compile(rb"[^0-9A-Za-z\x80-\xff\s]")
#: Upper edges of the bins of each statistic; a statistic is one feature: its bin.
EDGES = {
    "words": (1, 5, 15, 40, 100, 250, 600, 1500, 5000),
    "word_length": (1.5, 2.5, 3.5, 4.5, 5.5, 6.5, 8, 10, 14),
    "marks": (0.005, 0.02, 0.03, 0.04, 0.06, 0.09, 0.13, 0.2, 0.35),
    "capitals": (0.005, 0.015, 0.03, 0.06, 0.12, 0.25, 0.5, 0.8),
    "digits": (0.001, 0.005, 0.02, 0.05, 0.1, 0.2, 0.4),
    "distinct": (0.05, 0.1, 0.2, 0.3, 0.45, 0.6, 0.75, 0.9),
    "top_word": (0.02, 0.04, 0.06, 0.09, 0.13, 0.2, 0.35, 0.6),
    "repeated_lines": (0.01, 0.05, 0.1, 0.2, 0.35, 0.5, 0.75),
    "line_words": (1, 3, 6, 12, 25, 50, 100, 250),
    "marked_words": (0.02, 0.1, 0.2, 0.3, 0.45, 0.6, 0.75, 0.9),
    "repeated_phrases": (0.01, 0.03, 0.08, 0.15, 0.3, 0.5, 0.75),
    "declared_chars": (1, 20, 80, 250, 700, 2000, 6000, 20000),
}


@dataclass(frozen=True)
class FMParams:
    dims: int = 1 << 14  #: hashed features
    rank: int = 8
    sample: int = 12_000  #: labelled rows that the model is fitted on, at most
    epochs: int = 12
    rate: float = 0.02
    l2: float = 2e-4
    threshold: float = 0.7
    seed: int = 7


def statistics(text: bytes, n_chars: int | None, words: list[bytes], counts: Counter) -> dict[str, float]:
    n, size = len(words), max(len(text), 1)
    tokens = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    pairs = Counter(zip(words, words[1:], words[2:], strict=False))
    return {
        "words": n,
        "word_length": sum(map(len, words)) / n if n else 0,
        "marks": len(MARK.findall(text)) / size,
        "capitals": sum(map(len, re.findall(rb"[A-Z]+", text))) / size,
        "digits": sum(map(len, re.findall(rb"[0-9]+", text))) / size,
        "distinct": len(counts) / n if n else 0,
        "top_word": max(counts.values()) / n if n else 0,
        "repeated_lines": 1 - len(set(lines)) / len(lines) if lines else 0,
        "line_words": len(tokens) / len(lines) if lines else 0,
        "marked_words": sum(1 for x in tokens if not (x[-1:].isalnum() or x[-1] > 127)) / len(tokens) if tokens else 0,
        "repeated_phrases": 1 - len(pairs) / (n - 2) if n > 2 else 0,
        "declared_chars": n_chars if n_chars is not None else -1,
    }


def features(text: bytes | None, n_chars: int | None, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers (repeats allowed) and values; the words' values have norm 1."""
    text = text or b""
    words = WORD.findall(text.lower())
    counts = Counter(words)
    ids = [crc32(f"{k}:{int(np.searchsorted(EDGES[k], v, side='right'))}".encode()) % dims for k, v in statistics(text, n_chars, words, counts).items()]
    values = np.full(len(ids) + len(counts), 0.5, np.float32)
    if counts:
        ids += [crc32(w) % dims for w in counts]
        tf = 1 + np.log(np.fromiter(counts.values(), np.float32, len(counts)))
        values[len(EDGES) :] = tf / np.linalg.norm(tf)
    return np.array(ids, np.int32), values


def _featurise(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            xs = [features(t, n, dims) for t, n in zip(utf8(batch.column("text")), batch.column("n_chars").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), pa.array([i.tobytes() for i, _ in xs], pa.binary()), pa.array([v.tobytes() for _, v in xs], pa.binary())], names=["label", "ids", "vals"]
            )

    return run


class FactorisationMachine:
    def __init__(self, p: FMParams) -> None:
        rng = np.random.default_rng(p.seed)
        self.p, self.bias = p, 0.0
        self.w = np.zeros(p.dims, np.float32)
        self.v = rng.normal(0, 0.02, (p.dims, p.rank)).astype(np.float32)

    def raw(self, ids: np.ndarray, values: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Margins of ``n`` documents given as one list of entries, and their factor sums."""
        xv = self.v[ids] * values[:, None]
        sums = np.stack([np.bincount(rows, xv[:, f], n) for f in range(self.p.rank)], 1)
        squares = np.bincount(rows, (xv * xv).sum(1), n)
        linear = np.bincount(rows, self.w[ids] * values, n)
        return self.bias + linear + 0.5 * ((sums * sums).sum(1) - squares), sums

    def fit(self, docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> FactorisationMachine:
        """Adagrad on the log loss, in batches of 64, in a fixed order of shuffles."""
        p, rng, n = self.p, np.random.default_rng(self.p.seed), len(docs)
        share = (labels.sum() + 1) / (n + 2)
        self.bias = float(np.log(share / (1 - share)))
        if n == 0 or labels.min() == labels.max():
            self.v[:] = 0
            return self
        gw, gv, gb = np.full(p.dims, 1e-6, np.float32), np.full((p.dims, p.rank), 1e-6, np.float32), 1e-6
        for _ in range(p.epochs):
            order = rng.permutation(n)
            for s in range(0, n, 64):
                part = order[s : s + 64]
                rows = np.repeat(np.arange(len(part)), [len(docs[i][0]) for i in part])
                ids = np.concatenate([docs[i][0] for i in part])
                values = np.concatenate([docs[i][1] for i in part])
                raw, sums = self.raw(ids, values, rows, len(part))
                err = (1 / (1 + np.exp(-raw)) - labels[part]) / len(part)
                e = err[rows] * values
                used, at = np.unique(ids, return_inverse=True)
                dw = np.bincount(at, e, len(used)) + p.l2 * self.w[used] / len(part)
                dv_entries = e[:, None] * (sums[rows] - self.v[ids] * values[:, None])
                dv = np.stack([np.bincount(at, dv_entries[:, f], len(used)) for f in range(p.rank)], 1) + p.l2 * self.v[used] / len(part)
                gw[used] += dw**2
                gv[used] += dv**2
                gb += err.sum() ** 2
                self.w[used] -= (p.rate * 4 * dw / np.sqrt(gw[used])).astype(np.float32)
                self.v[used] -= (p.rate * dv / np.sqrt(gv[used])).astype(np.float32)
                self.bias -= p.rate * err.sum() / np.sqrt(gb)
        return self

    def score(self, docs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not docs:
            return np.zeros(0)
        rows = np.repeat(np.arange(len(docs)), [len(i) for i, _ in docs])
        raw, _ = self.raw(np.concatenate([i for i, _ in docs]), np.concatenate([v for _, v in docs]), rows, len(docs))
        return 1 / (1 + np.exp(-np.clip(raw, -60, 60)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, p: FMParams) -> DataFrame:
    """label_id, text, n_chars and label of at most ``p.sample`` labelled rows, one of an id: those of the smallest hashes, so the choice
    doesn't depend on the layout. That choice is made on ids; texts follow by a
    broadcast of at most ``p.sample`` ids, and of rows that repeat an id the one with the smallest hash of its text counts."""
    wanted = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").alias("label_id"))
        .agg(F.floor(F.avg("quality") + 0.5).cast("int").alias("label"))
        .orderBy(F.xxhash64("label_id"), "label_id")
        .limit(p.sample)
    )
    rows = docs.join(F.broadcast(wanted), F.col("doc_id") == F.col("label_id"))
    one = F.min(F.struct(F.xxhash64("text").alias("hash"), "n_chars", "text", "label")).alias("r")
    return rows.groupBy("label_id").agg(one).select("label_id", "r.text", "r.n_chars", "r.label")


def train(docs: DataFrame, labels: DataFrame, p: FMParams = FMParams()) -> FactorisationMachine:
    rows = training_rows(docs.select("doc_id", "text", F.col("n_chars").cast("long").alias("n_chars")), labels.select("doc_id", "quality"), p)
    got = rows.select("text", "n_chars", "label").mapInArrow(released(_featurise(p.dims)), "label int, ids binary, vals binary").toArrow().to_pydict()
    order = sorted(range(len(got["label"])), key=lambda i: (got["ids"][i], got["label"][i]))
    docs_ = [(np.frombuffer(got["ids"][i], np.int32), np.frombuffer(got["vals"][i], np.float32)) for i in order]
    return FactorisationMachine(p).fit(docs_, np.array([got["label"][i] for i in order], np.float64))


def score_documents(docs: DataFrame, model: FactorisationMachine) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` and ``predicted``; its other columns stay as they are,
    except columns of these three names, which are replaced."""
    p, shared = model.p, docs.sparkSession.sparkContext.broadcast(model)  # dims * (rank + 1) floats
    keep = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fm = shared.value
        for batch in slices(batches, "text", 2 << 20):
            xs = [features(t, n, p.dims) for t, n in zip(utf8(batch.column("text")), batch.column("n_chars").cast(pa.int64()).to_pylist(), strict=True)]
            scores = fm.score(xs)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "score"])

    schema = extended(docs.select(keep).schema, "score double")
    out = docs.select(keep).mapInArrow(released(run), schema)
    return out.select(*keep, held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= p.threshold).cast("int").alias("predicted"))
