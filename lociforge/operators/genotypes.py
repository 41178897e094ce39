"""Specimens as lists of locus genotypes, and all pairs of them without a shuffle.

A specimen is a few whole numbers: the genotype, a set of markers, that it shows at each locus. All of them together, four
bytes for a specimen and locus, go to the tasks once; no row is copied for a pair. Each task makes pairs of blocks of
specimens. A metric is given for two genotypes of a locus, of which a block has few, and summed up over the loci.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 512
PER_TASK = 8
MAX_TASKS = 20_000


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The whole numbers of all ranges, one range after another."""
    n = ends - starts
    return np.arange(n.sum()) + np.repeat(starts - (np.cumsum(n) - n), n)


class Genotypes:
    """``ids`` in order; specimen k shows the genotypes ``code[at[k]:at[k + 1]]``, genotype g the markers ``held[of[g]:of[g + 1]]``.

    ``marker`` and ``locus`` have the columns of markers and loci, by their numbers.
    """

    def __init__(self, ids: pa.Array, at: np.ndarray, no: np.ndarray, marker_locus: np.ndarray, n_loci: int, marker: dict, locus: dict):
        self.ids, self.n, self.n_loci, self.marker, self.locus = ids, len(ids), n_loci, marker, locus
        owner, loci = np.repeat(np.arange(self.n), np.diff(at)), marker_locus[no]
        first = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (loci[1:] != loci[:-1])]) if len(no) else np.zeros(0, np.int64)
        last, known = np.r_[first[1:], len(no)], {}
        no, code = np.ascontiguousarray(no, np.int32), np.zeros(len(first), np.int32)
        for k, (s, e) in enumerate(zip(first.tolist(), last.tolist())):
            code[k] = known.setdefault(no[s:e].tobytes(), len(known))
        sets = [np.frombuffer(x, np.int32) for x in known]
        self.code, self.at = code, np.searchsorted(owner[first], np.arange(self.n + 1))
        self.of = np.r_[0, np.cumsum([len(x) for x in sets], dtype=np.int64)]
        self.held = np.concatenate(sets) if sets else np.zeros(0, np.int32)
        self.at_locus = marker_locus[self.held[self.of[:-1]]]

    def codes(self, x: np.ndarray) -> np.ndarray:
        """The genotype of each of the specimens at each locus, -1 without a call."""
        out = np.full((len(x), self.n_loci), -1, np.int32)
        code = self.code[_ranges(self.at[x], self.at[x + 1])]
        out[np.repeat(np.arange(len(x)), self.at[x + 1] - self.at[x]), self.at_locus[code]] = code
        return out

    def rows_by_marker(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places in ``x`` that show a marker, and the markers, which are in order."""
        code = self.code[_ranges(self.at[x], self.at[x + 1])]
        row, mark = np.repeat(np.repeat(np.arange(len(x)), self.at[x + 1] - self.at[x]), self.of[code + 1] - self.of[code]), self.held[_ranges(self.of[code], self.of[code + 1])]
        at = np.argsort(mark, kind="stable")
        return row[at], mark[at]

    def loci(self, x: np.ndarray, y: np.ndarray) -> Iterator[tuple]:
        """For each locus that both sides have: its number, markers, both sides' genotypes, as sets of these markers, and each specimen's.

        ``(l, marks, gx, gy, a, b, cx, cy)``; a specimen without a call has the genotype -1, an empty set.
        """
        codes = self.codes(x), self.codes(y)
        for at in range(self.n_loci):
            (gx, cx), (gy, cy) = (np.unique(c[:, at], return_inverse=True) for c in codes)
            if gx[-1] < 0 or gy[-1] < 0:
                continue
            marks = np.unique(self.held[_ranges(self.of[g := np.union1d(gx, gy)[np.union1d(gx, gy) >= 0]], self.of[g + 1])])
            sets = []
            for g in (gx, gy):
                s = np.zeros((len(g), len(marks)))
                n = np.where(g >= 0, self.of[g + 1] - self.of[g], 0)
                s[np.repeat(np.arange(len(g)), n), np.searchsorted(marks, self.held[_ranges(self.of[g], self.of[g] + n)])] = 1
                sets.append(s)
            yield at, marks, gx, gy, *sets, cx, cy


def spread(table: np.ndarray, cx: np.ndarray, cy: np.ndarray) -> np.ndarray:
    """A table of genotypes as one of specimens."""
    return table[:, cy][cx]


def genotypes(own: DataFrame, marker: tuple[str, ...] = (), locus: tuple[str, ...] = ()) -> Genotypes:
    """Of ``own``: ``(seq_id, locus, marker)`` with columns that depend on the marker or on the locus.

    The driver passes on the specimens' numbers: four bytes a call.
    """
    spark = own.sparkSession
    known = own.select("locus", "marker", *marker, *locus).groupBy("locus", "marker").agg(*[F.first(c).alias(c) for c in (*marker, *locus)], F.count("*").alias("_n")).toArrow().sort_by([("locus", "ascending"), ("marker", "ascending")])
    names = known.column("locus").to_pylist()
    loci = list(dict.fromkeys(names))
    number = {x: k for k, x in enumerate(loci)}
    marker_locus = np.array([number[x] for x in names], np.int32)
    numbers = spark.createDataFrame(known.select(["locus", "marker"]).append_column("no", pa.array(np.arange(len(names)), pa.int32())))
    packed = own.join(F.broadcast(numbers), ["locus", "marker"]).groupBy("seq_id").agg(F.sort_array(F.collect_list("no")).alias("no")).toArrow().sort_by("seq_id")
    packed = packed.combine_chunks()
    lists = packed.column("no").combine_chunks() if packed.num_rows else pa.array([], pa.list_(pa.int32()))
    ids = packed.column("seq_id").combine_chunks() if packed.num_rows else pa.array([], pa.string())
    at = np.r_[0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)]
    first = np.unique(marker_locus, return_index=True)[1]
    col = lambda c: known.column(c).to_numpy()
    return Genotypes(ids, at, lists.flatten().to_numpy(zero_copy_only=False), marker_locus, len(loci), {c: col(c) for c in marker}, {c: col(c)[first] for c in locus})


def _tasks(spark: SparkSession, blocks: int, own: Callable[[Iterator[tuple[int, int]]], Iterator[pa.RecordBatch]], tasks: int, schema: str) -> DataFrame:
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs() -> Iterator[tuple[int, int]]:
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    bj = (math.isqrt(8 * k + 1) - 1) // 2
                    yield k - bj * (bj + 1) // 2, bj

        return own(pairs())

    pairs = blocks * (blocks + 1) // 2
    return spark.range(0, pairs, 1, max(1, min(pairs, tasks))).mapInArrow(made, schema)


def over_pairs(spark: SparkSession, shared, blocks: int, each: Callable[[object, int, int], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``each(shared, bi, bj)`` gives for every pair ``bi <= bj`` of blocks; ``shared`` is sent to the tasks once."""
    sent = spark.sparkContext.broadcast(shared)

    def own(pairs: Iterator[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
        for bi, bj in pairs:
            yield from each(sent.value, bi, bj)

    tasks = min(MAX_TASKS, max(spark.sparkContext.defaultParallelism, blocks * blocks // (2 * PER_TASK)))
    return _tasks(spark, blocks, own, tasks, schema)


def fold_pairs(spark: SparkSession, shared, blocks: int, start: Callable, step: Callable, end: Callable, schema: str, per_core: int = 4) -> DataFrame:
    """One table from each of few tasks: ``end(step(... start(shared), shared, bi, bj ...))`` over its pairs of blocks."""
    sent = spark.sparkContext.broadcast(shared)

    def own(pairs: Iterator[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
        state = start(sent.value)
        for bi, bj in pairs:
            state = step(state, sent.value, bi, bj)
        yield from end(state).to_batches()

    return _tasks(spark, blocks, own, per_core * spark.sparkContext.defaultParallelism, schema)


def blocks_of(n: int, block: int) -> int:
    return math.ceil(n / block)


def pair_rows(spark: SparkSession, shared: Genotypes, metric: Callable, block: int = BLOCK, value: Callable | None = None) -> DataFrame:
    """``(i, j, d)`` of all pairs, i before j: ``metric(shared, x, y)`` gives the distances and which of them to keep (None: all)."""

    def each(own: Genotypes, bi: int, bj: int) -> Iterator[pa.RecordBatch]:
        x, y = (np.arange(b * block, min(own.n, (b + 1) * block)) for b in (bi, bj))
        d, keep = metric(own, x, y)
        if bi == bj:
            upper = np.triu(np.ones(d.shape, bool), 1)
            keep = upper if keep is None else keep & upper
        i, j = np.repeat(x, len(y)), np.tile(y, len(x))
        d = d.ravel()
        if keep is not None:
            ok = np.flatnonzero(keep.ravel())
            i, j, d = i[ok], j[ok], d[ok]
        yield pa.RecordBatch.from_arrays([own.ids.take(pa.array(i)), own.ids.take(pa.array(j)), pa.array(d)], names=["i", "j", "d"])

    return over_pairs(spark, shared, blocks_of(shared.n, block), each, "i string, j string, d double")


def pairs_within(spark: SparkSession, shared: Genotypes, metric: Callable, label: np.ndarray, block: int = BLOCK) -> DataFrame:
    """``(i, j, d)`` of the pairs of one label; specimens of label -1 have none."""
    order = np.argsort(label, kind="stable")
    order = order[label[order] >= 0]

    def each(sent: tuple, bi: int, bj: int) -> Iterator[pa.RecordBatch]:
        own, at, of = sent
        x, y = (at[b * block : (b + 1) * block] for b in (bi, bj))
        if of[x[-1]] < of[y[0]]:  # labels are in order
            return
        keep = of[x][:, None] == of[y][None, :]
        i, j = np.nonzero(np.triu(keep, 1) if bi == bj else keep)
        d = metric(own, x, y)[i, j]
        yield pa.RecordBatch.from_arrays([own.ids.take(pa.array(x[i])), own.ids.take(pa.array(y[j])), pa.array(d)], names=["i", "j", "d"])

    return over_pairs(spark, (shared, order, label), blocks_of(len(order), block), each, "i string, j string, d double")
