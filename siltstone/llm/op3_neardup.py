"""MinHash near-dedup with an LSH forest.

1.  Each text becomes its set of 64-bit shingle hashes; equal sets are one class
    straight away (an aggregate on the set's fingerprint), so the rest works on one
    representative per set.
2.  ``trees * depth`` MinHashes. Tree ``t`` orders the representatives by its own ``depth`` of them. Those that share two leading
    hashes with no other, in any tree, are leaves without neighbours and drop out before anything wide is moved.
3.  Round 1: the orders are range-partitioned (a hot prefix is cut across partitions) and sorted. Each entry's candidates are its ``near``
    neighbours on both sides, which have the longest common prefixes with it: deep in a crowded region, two hashes in a sparse one
    (adaptive depth). Sketches of one bit for each of ``bits`` further MinHashes estimate the similarity; a spanning forest of
    the likely pairs (fewer pairs than entries, however dense a region is) is confirmed on the full sets and joins what is linked.
4.  What neighbours can't see (a region with more members than ``near`` between two that are alike, and a partition's border) is
    left to rounds 2 and 3: there all that share a tree's two leading hashes and are of different components meet. A prefix whose members are of one
    component by then, the usual case, moves nothing. In others the largest component's members don't meet one another: they are dealt into groups
    of about ``cell`` that each meet all groups of the rest, once; pairs of groups are cells of their own, for any task.
    Round 2 takes a spanning forest of the components a cell sees, round 3 every candidate pair that is still between different
    components.
5.  Components by alternating minimum stars over the confirmed links.

Confirmation joins full sets by key; nothing is collected to the driver but counts, and nothing that grows with the corpus
is broadcast. The result is the components of all confirmed pairs that share two leading hashes in a tree, so it doesn't depend on
partitions. A pair of similarity 0.8 is missed with a probability of about 1e-4 by itself, in a group of any size: it meets in no tree
with ``(1 - 0.8 ** 2) ** trees`` = 5e-6, and the estimate's margin is four standard deviations
(``2 * sqrt(0.9 * 0.1 / bits)`` each, as two unlike minima share a bit half the time).

Defined results: null, empty and blank texts have the empty set, link with nothing
and are kept; fewer than four words are one shingle of all; very long texts give their whole set; repeated rows of one
``doc_id`` and text are of one class and each is returned; rows of one ``doc_id`` with different texts are linked only as
their texts are, each class with its own component, named by its smallest ``doc_id``; a null ``doc_id`` is alone: its
component is null and it is kept; ties don't arise (a component is a set). Columns other than doc_id and text are not read and not returned;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import discard, materialise, released, slices, utf8

MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D], np.uint64)


@dataclass(frozen=True)
class ForestParams:
    words: int = 4  #: of a shingle
    percent: int = 80  #: least similarity, per cent
    trees: int = 12
    depth: int = 8
    near: int = 8  #: neighbours on each side in a tree's order
    cell: int = 1024  #: members of a prefix before they are dealt into groups of about as many
    bits: int = 2048  #: of a sketch
    margin: float = 0.055  #: a candidate's estimate may be that much below the limit
    seed: int = 11


class _Words(dict):
    """Word hashes, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_words = _Words()


def shingles(text: bytes | None, width: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's shingles."""
    words = text.lower().split() if text else []  # bytes.lower() is A-Z only, bytes.split() cuts at \x09-\x0d and \x20
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(h.tobytes(), len(words))], np.uint64)
    n = len(words) - width + 1
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out = (out ^ (out >> np.uint64(29))) * MIX[0] + h[j : j + n] * MIX[j % 8]
    return np.unique(out)


def _coefficients(p: ForestParams) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Multipliers and addends: 64-bit ones of the signature, 32-bit ones of the sketch."""
    rng = np.random.default_rng(p.seed)
    k = p.trees * p.depth
    long = rng.integers(0, 2**63, k).astype(np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, k).astype(np.uint64)
    return *long, rng.integers(0, 2**31, p.bits).astype(np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, p.bits).astype(np.uint32)


def signature(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    best = np.full(len(a), 2**32 - 1, np.uint64)
    for i in range(0, len(s), 512):
        x = s[None, i : i + 512] * a[:, None] + b[:, None]
        best = np.minimum(best, (x >> np.uint64(32)).min(1))
    return best.astype(np.uint32)


def sketch(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A bit of each 32-bit MinHash, packed."""
    best, short = np.full(len(a), 2**32 - 1, np.uint32), (s >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(s), 128):
        x = short[i : i + 128, None] * a
        x += b
        np.minimum(best, x.min(0), out=best)
    best ^= best >> np.uint32(15)
    return np.packbits((best * np.uint32(0x9E3779B1)) >> np.uint32(31) != 0)


def signatures(docs: DataFrame, p: ForestParams) -> DataFrame:
    """doc_id, text_key (the text's hash), n_shingles, fp (the set's fingerprint) and sig; the last two null for the empty set."""
    a, b, *_ = _coefficients(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            sets = [shingles(t, p.words) for t in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_key"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([signature(s, a, b).astype(">u4").tobytes() if len(s) else None for s in sets], pa.binary()),
                ],
                names=["doc_id", "text_key", "n_shingles", "fp", "sig"],
            )
        _words.clear()  # a worker outlives its task

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    return rows.mapInArrow(released(run), "doc_id long, text_key long, n_shingles long, fp binary, sig binary")


def _entries(reps: DataFrame, p: ForestParams) -> DataFrame:
    """A row for each tree and representative: the tree's key, and the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = 4 * p.depth
        for batch in batches:
            for s in range(0, batch.num_rows, 2000):
                part = batch.slice(s, 2000)
                n = part.num_rows
                sigs = part.column("sig").to_pylist()
                for t in range(p.trees):
                    key = pa.array([x[t * wide : (t + 1) * wide] for x in sigs], pa.binary())
                    columns = [pa.array(np.full(n, t, np.int32)), key, part.column("id"), part.column("n").cast(pa.int32()), part.column("sketch")]
                    yield pa.RecordBatch.from_arrays(columns, names=["tree", "key", "id", "n", "sketch"])

    return reps.select("id", "n", "sig", "sketch").mapInArrow(released(run), "tree int, key binary, id long, n int, sketch binary")


def _forest(a: np.ndarray, b: np.ndarray, estimates: np.ndarray) -> np.ndarray:
    """Which pairs make a spanning forest, the likeliest first."""
    root: dict[int, int] = {}

    def top(c: int) -> int:
        while root.setdefault(c, c) != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    keep = []
    order = np.lexsort((b, a, -estimates))
    for k, x, y in zip(order.tolist(), a[order].tolist(), b[order].tolist(), strict=True):
        x, y = top(x), top(y)
        if x != y:
            root[x] = y
            keep.append(k)
    return np.array(keep, np.int64)


def _neighbours(p: ForestParams):
    """Round 1's candidates from sorted entries: neighbours with the longest common prefixes, a forest of the likely ones."""
    least = p.percent / 100 - p.margin

    def found(part: pa.Table) -> Iterator[pa.RecordBatch]:
        n = part.num_rows
        keys = np.frombuffer(b"".join(part.column("key").to_pylist()), ">u4").reshape(n, p.depth)
        words = np.frombuffer(b"".join(part.column("sketch").to_pylist()), np.uint64).reshape(n, -1)
        tree, ids, sizes = (part.column(c).to_numpy() for c in ("tree", "id", "n"))
        sizes = sizes.astype(np.int64)
        xs, ys, es = [], [], []
        for d in range(1, min(p.near, n - 1) + 1):
            few, many = np.minimum(sizes[d:], sizes[:-d]), np.maximum(sizes[d:], sizes[:-d])
            y = d + np.flatnonzero((tree[d:] == tree[:-d]) & (keys[d:, :2] == keys[:-d, :2]).all(1) & (100 * few >= p.percent * many))
            estimate = 1 - np.bitwise_count(words[y] ^ words[y - d]).sum(1, dtype=np.int64) / (32 * words.shape[1])
            ok = estimate >= least
            xs.append(y[ok] - d)
            ys.append(y[ok])
            es.append(estimate[ok])
        if xs and sum(map(len, xs)):
            a, b, e = ids[np.concatenate(xs)], ids[np.concatenate(ys)], np.concatenate(es)
            keep = _forest(a, b, e)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[keep]), pa.array(np.maximum(a, b)[keep])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: list[pa.RecordBatch] = []
        for batch in batches:
            for s in range(0, batch.num_rows, 20_000):
                whole = pa.Table.from_batches([*before, batch.slice(s, 20_000)])
                yield from found(whole)
                before = whole.slice(max(0, whole.num_rows - p.near)).to_batches()

    return run


def candidates(reps: DataFrame, p: ForestParams) -> DataFrame:
    n = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = _entries(reps, p).repartitionByRange(n, "tree", "key", "id").sortWithinPartitions("tree", "key", "id")
    return sorted_.mapInArrow(released(_neighbours(p)), "a long, b long").distinct()


def prefixes(reps: DataFrame, p: ForestParams) -> DataFrame:
    """tree, prefix (a number of the tree and its two leading hashes) and id, for each tree and representative."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), ">u4").reshape(batch.num_rows, p.trees, p.depth)[:, :, :2].astype(np.uint64)
            prefix = (((sig[:, :, 0] << np.uint64(32)) + sig[:, :, 1]) * MIX[1] + np.arange(p.trees, dtype=np.uint64)[None] * MIX[2]).view(np.int64)
            for t in range(p.trees):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, t, np.int32)), pa.array(prefix[:, t]), batch.column("id")], names=["tree", "prefix", "id"])

    return reps.select("id", "sig").mapInArrow(released(run), "tree int, prefix long, id long")


def alive(reps: DataFrame, p: ForestParams) -> tuple[DataFrame, DataFrame]:
    """Representatives that share a prefix with another, and the shared prefixes' rows (tree, prefix, id)."""
    every = materialise(prefixes(reps, p), "prefixes")
    shared = every.groupBy("prefix").agg(F.count("*").alias("c")).where("c > 1").select("prefix")
    members = materialise(every.join(shared.hint("merge"), "prefix", "left_semi"), "shared")
    out = materialise(reps.join(members.select("id").distinct().hint("merge"), "id", "left_semi"), "alive")
    discard(every)
    return out, members


def _cells(reps: DataFrame, p: ForestParams) -> DataFrame:
    """A row for each cell in which a representative meets others, with its dealt prefixes by tree (0 where it has none).
    ``dealt``: the prefixes with their largest component and the numbers of groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 500):
                part = batch.slice(s, 500)
                spread = (part.column("id").to_numpy().astype(np.uint64) * MIX[3] >> np.uint64(33)).astype(np.int64).tolist()
                comps, row, at = part.column("comp").to_pylist(), [], []
                of = np.zeros((part.num_rows, p.trees), np.int64)
                every = part.column("dealt").to_pylist()
                for k, dealt in enumerate(every):
                    for d in dealt:
                        of[k, d["tree"]] = d["prefix"]
                part = part.append_column("of", pa.array([x.tobytes() for x in of], pa.binary()))
                for k, dealt in enumerate(every):
                    for d in dealt:
                        prefix, large, rest = d["prefix"], d["large"], d["rest"]
                        if comps[k] == d["main"]:  # meets the rest's groups
                            own = -1 - spread[k] % large
                            new = [(prefix, own, j, 0) for j in range(rest)]
                        else:
                            own = spread[k] % rest
                            new = [(prefix, -1 - g, own, 1) for g in range(large)]
                            new += [(prefix, min(own, j), max(own, j), int(own > j)) for j in range(rest)]
                        at += new
                        row += [k] * len(new)
                    if len(row) > 20_000 or k == part.num_rows - 1 and row:
                        rest_ = part.select(["id", "comp", "n", "sketch", "of"]).take(pa.array(row))
                        cell = [pa.array(x, t) for x, t in zip(zip(*at, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)]
                        yield pa.RecordBatch.from_arrays([*cell, rest_.column("id"), rest_.column("comp"), rest_.column("n").cast(pa.int32()), rest_.column("sketch"), rest_.column("of")], names=["prefix", "i", "j", "side", "id", "comp", "n", "sketch", "of"])
                        row, at = [], []

    return reps.select("id", "comp", "n", "sketch", "dealt").mapInArrow(released(run), "prefix long, i int, j int, side int, id long, comp long, n int, sketch binary, of binary")


def _met(p: ForestParams, forest: bool):
    """Candidates between different components from rows sorted by cell, which is held whole: of a forest only the pairs that join
    components, else each pair in the first tree in which it meets."""
    least = p.percent / 100 - p.margin

    def found(prefix: int, square: bool, side: np.ndarray, ids: np.ndarray, comps: np.ndarray, sizes: np.ndarray, words: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if square:
            right = left
        left = left[np.argsort(comps[left], kind="stable")]
        xs, ys, es = [], [], []
        for s in range(0, len(left), 256):
            x, y = left[s : s + 256], right
            if comps[x[0]] == comps[x[-1]]:
                y = y[comps[y] != comps[x[0]]]
            if not len(y):
                continue
            differ = np.zeros((len(x), len(y)), np.uint16)
            for k in range(words.shape[1]):
                differ += np.bitwise_count(words[x, None, k] ^ words[None, y, k])
            estimate = 1 - differ / (32 * words.shape[1])
            few, many = np.minimum(sizes[x, None], sizes[None, y]), np.maximum(sizes[x, None], sizes[None, y])
            ok = (estimate >= least) & (100 * few >= p.percent * many) & (comps[x, None] != comps[None, y])
            if square:
                ok &= x[:, None] < y[None]
            u, v = np.nonzero(ok)
            xs.append(x[u])
            ys.append(y[v])
            es.append(estimate[u, v])
        if not xs:
            return ids[:0], ids[:0]
        x, y, e = np.concatenate(xs), np.concatenate(ys), np.concatenate(es)
        if forest:
            keep = _forest(comps[x], comps[y], e)
        else:
            shared = (of[x] == of[y]) & (of[x] != 0)
            keep = np.flatnonzero(of[x, shared.argmax(1)] == prefix)
        x, y = x[keep], y[keep]
        return np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(whole: pa.Table, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
            i, j, side, ids, comps, sizes = (whole.column(c).to_numpy() for c in ("i", "j", "side", "id", "comp", "n"))
            words = np.frombuffer(b"".join(whole.column("sketch").to_pylist()), np.uint64).reshape(whole.num_rows, -1)
            of = np.frombuffer(b"".join(whole.column("of").to_pylist()), np.int64).reshape(whole.num_rows, -1)
            prefix, sizes, out, held = whole.column("prefix").to_numpy(), sizes.astype(np.int64), [], 0
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if e - s > 1 and (comps[s:e] != comps[s]).any():
                    out.append(found(prefix[s], i[s] == j[s], side[s:e], ids[s:e], comps[s:e], sizes[s:e], words[s:e], of[s:e]))
                    held += len(out[-1][0])
                if held > 100_000 or e == cuts[-1] and held:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*out, strict=True)], names=["a", "b"])
                    out, held = [], 0

        rest: list[pa.RecordBatch] = []
        for batch in batches:
            whole = pa.Table.from_batches([*rest, batch])
            place = [whole.column(c).to_numpy() for c in ("prefix", "i", "j")]
            cuts = np.concatenate([[0], np.flatnonzero(np.any([x[1:] != x[:-1] for x in place], 0)) + 1])
            if cuts[-1]:
                yield from work(whole.slice(0, int(cuts[-1])), cuts)
            rest = whole.slice(int(cuts[-1])).to_batches()
        if rest:
            whole = pa.Table.from_batches(rest)
            yield from work(whole, np.array([0, whole.num_rows]))

    return run


def met(near: DataFrame, members: DataFrame, p: ForestParams, forest: bool) -> DataFrame:
    """Candidates between different components of all that share a prefix, however many. ``near``: id, n, sketch and comp."""
    of = materialise(members.join(near.select("id", "comp").hint("merge"), "id"), "members")
    counts = of.groupBy("prefix", "comp").agg(F.count("*").alias("c"))
    mixed = counts.groupBy("prefix").agg(F.max(F.struct("c", "comp")).alias("m"), F.sum("c").alias("total"), F.count("*").alias("comps")).where("comps > 1")
    groups = [F.ceil(c / p.cell).cast("int") for c in (F.col("m.c"), F.col("total") - F.col("m.c"))]
    mixed = mixed.select("prefix", F.col("m.comp").alias("main"), groups[0].alias("large"), groups[1].alias("rest"))
    dealt = of.select("tree", "prefix", "id").join(mixed.hint("merge"), "prefix").groupBy("id").agg(F.collect_list(F.struct("tree", "prefix", "main", "large", "rest")).alias("dealt"))  # at most one a tree
    n = int(near.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = _cells(near.join(dealt.hint("merge"), "id"), p).repartition(n, "prefix", "i", "j").sortWithinPartitions("prefix", "i", "j")
    out = materialise(cells.mapInArrow(released(_met(p, forest)), "a long, b long").distinct(), "met")
    discard(of)
    return out


def full_sets(docs: DataFrame, near: DataFrame, p: ForestParams) -> DataFrame:
    """id, set (little-endian sorted hashes) and sketch of ``near`` (id, doc_id, fp), from whole texts."""
    *_, a, b = _coefficients(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            out = []
            for text, of in zip(utf8(batch.column("text")), batch.column("of").to_pylist(), strict=True):
                s = shingles(text, p.words)
                raw = s.tobytes()
                fp = xxhash.xxh128_digest(raw)
                out += [(x["id"], raw, sketch(s, a, b).tobytes()) for x in of if x["fp"] == fp]
            columns = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["id", "set", "sketch"])
        _words.clear()

    wanted = near.groupBy("doc_id").agg(F.collect_list(F.struct("fp", "id")).alias("of"))  # one, but for ids with different texts
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    found = texts.join(wanted.hint("merge"), "doc_id").select("text", "of").mapInArrow(released(run), "id long, set binary, sketch binary")
    return materialise(found.dropDuplicates(["id"]), "sets")


def confirm(pairs: DataFrame, sets: DataFrame, p: ForestParams) -> DataFrame:
    """Those of the pairs whose full sets are similar enough."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "x", 4 << 20):
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= p.percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = materialise(pairs, "pairs")
    used = materialise(sets.select("id", "set").join(pairs.select(F.col("a").alias("id")).distinct().union(pairs.select("b").distinct()).hint("merge"), "id", "left_semi"), "used")
    out = (
        pairs.join(used.select(F.col("id").alias("a"), F.col("set").alias("x")).hint("merge"), "a")
        .join(used.select(F.col("id").alias("b"), F.col("set").alias("y")).hint("merge"), "b")
        .select("a", "b", "x", "y")
        .mapInArrow(released(compare), "a long, b long")
    )
    links = materialise(out.distinct(), "links")
    discard(used, pairs)
    return links


def _measured(edges: DataFrame, tag: str) -> tuple[DataFrame, dict]:
    """The edges, written, and their number and fingerprint, from the same pass."""
    seen = Observation()
    out = materialise(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("s")), tag)
    return out, seen.get


def components(links: DataFrame) -> DataFrame:
    """id, comp (the smallest id reachable) of the links' ends: alternating large and small
    stars. An id's smallest neighbour comes from an aggregate with map-side combining;
    it is written before it is joined, so that the join has a plain exchange on both sides and a
    hub's partition can be split at run time."""
    edges, state = _measured(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while state["n"]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = materialise(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        low = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        joined = large.join(low, "u").select("u", "v", "m")
        pairs = joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        small, after = _measured(pairs.select("e.u", "e.v").where("u <> v").distinct(), "small")
        discard(least, low, large, edges)
        edges, before, state = small, state, after
        if state == before:
            break
    star = edges.select(F.col("u").alias("id"), F.col("v").alias("comp")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("comp")))
    out = materialise(star.distinct(), "components")
    discard(edges)
    return out


def _numbered(reps: DataFrame, comps: DataFrame | None) -> DataFrame:
    if comps is None:
        return reps.withColumn("comp", F.col("id"))
    return reps.join(comps.hint("merge"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))


def grouped(docs: DataFrame, p: ForestParams = ForestParams()) -> DataFrame:
    """doc_id, text_key, n_shingles, class (a number of the component, null if alone) and component_id of each row of ``docs`` (doc_id, text)."""
    every = materialise(signatures(docs, p), "signatures")
    some = every.where("fp is not null and doc_id is not null")
    best = F.min(F.struct("doc_id", "n_shingles", "sig"))
    reps = some.groupBy("fp").agg(best.alias("r")).select("fp", F.col("r.doc_id").alias("doc_id"), F.col("r.n_shingles").alias("n"), "r.sig")
    reps = materialise(reps, "reps")
    shared = materialise(reps.groupBy("doc_id").agg(F.min("fp").alias("first"), F.count("*").alias("c")).where("c > 1").drop("c"), "shared-ids")
    repeated = not shared.isEmpty()
    if repeated:  # sets that share a smallest doc_id: one takes it as its number, the others numbers of their own
        own = F.when(F.col("first").isNull() | (F.col("first") == F.col("fp")), F.col("doc_id")).otherwise(-F.shiftrightunsigned(F.xxhash64("fp"), 2) - (1 << 62))
        numbered = materialise(reps.join(shared.hint("merge"), "doc_id", "left").withColumn("id", own).drop("first"), "numbered")
        discard(reps)
        reps = numbered
    else:
        reps = reps.withColumn("id", F.col("doc_id"))
    bare, members = alive(reps, p)
    sets = full_sets(docs, bare, p)
    near = materialise(bare.join(sets.select("id", "sketch").hint("merge"), "id"), "sketched")
    discard(bare)
    comps = components(confirm(candidates(near, p), sets, p))
    for forest in (True, False):
        found = met(_numbered(near, comps), members, p, forest)
        more = confirm(found, sets, p)
        discard(found)
        if not more.isEmpty():
            old, comps = comps, components(more.union(comps.select(F.col("id").alias("a"), F.col("comp").alias("b"))))
            discard(old)
    classes = _numbered(reps.select("fp", "id", "doc_id"), comps).select("fp", F.col("comp").alias("class"), "doc_id")
    if repeated:
        names = classes.groupBy("class").agg(F.min("doc_id").alias("component_id"))
        classes = classes.join(names.hint("merge"), "class").select("fp", "class", "component_id")
    else:
        classes = classes.select("fp", "class", F.col("class").alias("component_id"))
    classes = materialise(classes, "classes")
    discard(near, sets, members, comps, shared)
    light = every.select("doc_id", "text_key", "n_shingles", "fp")
    linked = light.where("fp is not null and doc_id is not null").join(classes, "fp", "left").select("doc_id", "text_key", "n_shingles", "class", "component_id")
    alone = light.where("fp is null or doc_id is null").select("doc_id", "text_key", "n_shingles", F.lit(None).cast("long").alias("class"), F.col("doc_id").alias("component_id"))
    return linked.union(alone)


def near_duplicates(docs: DataFrame, p: ForestParams = ForestParams()) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``docs`` (doc_id, text)."""
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return grouped(docs, p).select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def survivors(docs: DataFrame, p: ForestParams = ForestParams()) -> DataFrame:
    """doc_id, text_key and gone (true or false) of each distinct row: of a class one row stays, that of the smallest doc_id, then text_key.
    Rows that are alone stay."""
    rows = materialise(grouped(docs, p).groupBy("doc_id", "text_key", "class").agg(F.count("*").alias("copies")), "grouped")
    first = rows.where("class is not null").groupBy("class").agg(F.min(F.struct("doc_id", "text_key")).alias("first"))
    found = rows.join(first.hint("merge"), "class", "left")
    return found.select("doc_id", "text_key", "copies", F.coalesce(F.struct("doc_id", "text_key") != F.col("first"), F.lit(False)).alias("gone"))
