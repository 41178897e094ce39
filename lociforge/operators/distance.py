"""Pairwise specimen distances.

The metrics are sums over common loci. Each is a table of the genotypes that two blocks of specimens show at a locus,
and no row is made for a pair and locus, nor copied for a pair; see ``genotypes``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociforge.operators.genotypes import BLOCK, Genotypes, blocks_of, fold_pairs, genotypes, over_pairs, pair_rows, spread
from lociforge.operators.ordering import numbered, value_counts
from lociforge.operators.sheet import allele_frequencies, allele_shares, complete_calls, entropies, marker_dimension, snp_locus_weights
from lociforge.session import Cut

EPSILON = 0.3072
SAME = 1e-13


def _weighted(calls: DataFrame, ploidy, min_completeness: float) -> DataFrame:
    """``(seq_id, locus, marker, wq, wl)``: the calls of complete specimens with each marker's and locus's weight."""
    kept = complete_calls(calls, min_completeness)
    weights = allele_frequencies(kept, marker_dimension(calls, ploidy)).select("locus", "marker", "ploidy", "w")
    per_locus = weights.groupBy("locus").agg(F.sum("w").alias("wl"))
    return kept.join(weights, ["locus", "marker"]).join(per_locus, "locus").select("seq_id", "locus", "marker", (F.col("w") / F.col("ploidy")).alias("wq"), "wl")


def wibs_of_pairs(pairs: DataFrame, calls: DataFrame, cut: Cut, ploidy=None, min_completeness: float = 0.10) -> DataFrame:
    """The rows ``(i, j, d)`` of ``wibs_pairs`` that the distinct ``(i, j)`` of ``pairs`` name; no other pair is made."""
    own = cut.write(_weighted(calls, ploidy, min_completeness))
    known = numbered(own.select("locus", "marker").distinct(), ["locus", "marker"], "no", cut)
    known = cut.write(known.join(known.groupBy("locus").agg(F.min("no").alias("l")), "locus"))
    packed = own.join(known, ["locus", "marker"]).groupBy("seq_id").agg(F.sort_array(F.collect_list(F.struct("no", "l", "wq", "wl"))).alias("c"))
    packed = cut.write(packed.select("seq_id", "c.no", "c.l", "c.wq", "c.wl"))
    of = lambda end: packed.select(F.col("seq_id").alias(end), F.struct("no", "l", "wq", "wl").alias(f"c{end}"))
    both = pairs.select("i", "j").join(of("i"), "i").join(of("j"), "j")

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, y in zip(batch.column("ci"), batch.column("cj")):
                x, y = x.as_py(), y.as_py()
                called, other = dict(zip(x["l"], x["wl"])), set(y["l"])
                den = math.fsum(w for k, w in called.items() if k in other)
                held = dict(zip(x["no"], x["wq"]))
                num = [w for k, w in zip(x["l"], x["wq"]) if k in other] + [w for k, w in zip(y["l"], y["wq"]) if k in called] + [-2 * w for m, w in zip(y["no"], y["wq"]) if m in held]
                out.append(max(math.fsum(num), 0.0) / den if den > 0 else 1.0)
            yield pa.RecordBatch.from_arrays([batch.column("i"), batch.column("j"), pa.array(out, pa.float64())], names=["i", "j", "d"])

    return both.mapInArrow(distances, "i string, j string, d double")


def wibs_distances(own: Genotypes, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of specimens ``x`` and ``y`` of ``wibs_genotypes``.

    Markers of one side only weigh by the product of what each side holds and the other has called; of the common ones,
    which are few, that is taken off again for each pair that shows them.
    """
    wq, wl = own.marker["wq"], own.locus["wl"]
    sums = np.r_[np.add.reduceat(wq[own.held], own.of[:-1]) if len(own.of) > 1 else np.zeros(0), 0.0]  # of each genotype; without a call 0
    (px, cx), (py, cy) = ((sums[c], (c >= 0).astype(float)) for c in (own.codes(x), own.codes(y)))
    num, den = np.hstack([px, cx]) @ np.hstack([cy, py]).T, (cx * wl) @ cy.T
    (rx, mx), (ry, my) = own.rows_by_marker(x), own.rows_by_marker(y)
    common = np.intersect1d(mx, my)
    (a, b), (c, e) = ((np.searchsorted(m, common), np.searchsorted(m, common, "right")) for m in (mx, my))
    size = (b - a) * (e - c)
    cells, end, rx = np.empty(size.sum(), np.int64), np.cumsum(size), rx * len(y)
    for f, t, g, u, last in zip(a.tolist(), b.tolist(), c.tolist(), e.tolist(), end.tolist()):
        np.add(rx[f:t, None], ry[g:u], out=cells[last - (t - f) * (u - g) : last].reshape(t - f, u - g))
    num -= np.bincount(cells, np.repeat(2 * wq[common], size), minlength=num.size).reshape(num.shape)
    apart = den <= 0
    if apart.any():
        num[apart] = den[apart] = 1
    num /= den
    num[num < SAME] = 0  # equal genotypes but for the last bits
    return num


def wibs_genotypes(calls: DataFrame, ploidy=None, min_completeness: float = 0.10) -> Genotypes:
    """The complete specimens for ``wibs_distances``."""
    with Cut(calls.sparkSession) as cut:  # each call is read more than once
        return genotypes(cut.write(_weighted(cut.write(calls), ploidy, min_completeness)), ("wq",), ("wl",))


def wibs_pairs(calls: DataFrame, ploidy=None, min_completeness: float = 0.10, block: int = BLOCK, max_distance: float | None = None) -> DataFrame:
    """``(i, j, d)``, i before j: weighted identity-by-state before the projection; 1.0 without a common locus.

    ``calls``: distinct ``(seq_id, locus, marker)``. With ``max_distance`` only nearer pairs leave the tasks.
    """

    def metric(own: Genotypes, x: np.ndarray, y: np.ndarray) -> tuple:
        d = wibs_distances(own, x, y)
        return d, None if max_distance is None else d <= max_distance

    return pair_rows(calls.sparkSession, wibs_genotypes(calls, ploidy, min_completeness), metric, block)


def _allele_distances(sequences: list[str | None]) -> np.ndarray:
    """Mismatches on the common prefix plus the difference of lengths, over the greater length; 1 without a sequence."""
    n = len(sequences)
    lengths = np.array([len(s or "") for s in sequences])
    letters = np.zeros((n, max(lengths, default=0)), np.uint8)
    for k, s in enumerate(sequences):
        letters[k, : lengths[k]] = np.frombuffer((s or "").encode(), np.uint8)
    out = np.ones((n, n))
    for k in range(n):
        if sequences[k] is not None:
            longest = np.maximum(lengths, lengths[k])
            equal = (letters[:, : lengths[k]] == letters[k, : lengths[k]]).sum(1)
            out[k] = np.where([s is not None for s in sequences], np.where(longest > 0, (longest - equal) / np.maximum(longest, 1), 0), 1)
    np.fill_diagonal(out, 0)
    return out


def snp_pairs(calls: DataFrame, sequences: DataFrame, ploidy=None, min_completeness: float = 0.10, block: int = BLOCK, every: bool = False) -> DataFrame:
    """``(i, j, d)`` of comparable pairs: mean over common loci of the least sequence distance of their alleles.

    ``sequences``: ``(marker, sequence)``; an allele without one is at distance 1 from all others. With ``every`` all
    pairs, 1 without a common locus. The tasks get the sequences of the markers that have one.
    """
    kept = complete_calls(calls, min_completeness)
    weights = snp_locus_weights(kept, marker_dimension(calls, ploidy))
    known = sequences.filter("sequence is not null").groupBy("marker").agg(F.first("sequence").alias("sequence"))
    shared = genotypes(kept.join(weights, "locus").join(known, "marker", "left"), ("sequence",), ("w",))

    def metric(own: Genotypes, x: np.ndarray, y: np.ndarray) -> tuple:
        total, weight = np.zeros((len(x), len(y))), np.zeros((len(x), len(y)))
        for at, marks, gx, gy, a, b, cx, cy in own.loci(x, y):
            apart = _allele_distances(list(own.marker["sequence"][marks]))
            from_right = np.full((len(marks), len(gy)), np.inf)  # of each allele from each right genotype
            for m in range(len(marks)):
                has = np.flatnonzero(b[:, m])
                from_right[:, has] = np.minimum(from_right[:, has], apart[:, m : m + 1])
            least = np.full((len(gx), len(gy)), np.inf)
            for m in range(len(marks)):
                has = np.flatnonzero(a[:, m])
                least[has] = np.minimum(least[has], from_right[m])
            common, w = np.isfinite(least), own.locus["w"][at]
            total += spread(np.where(common, least, 0) * w, cx, cy)
            weight += spread(common * w, cx, cy)
        d = np.where(weight > 0, total / np.where(weight > 0, weight, 1), 1.0)
        return d, None if every else weight > 0

    return pair_rows(calls.sparkSession, shared, metric, block)


def _barratt_genotypes(calls: DataFrame, ploidy, min_completeness: float) -> Genotypes:
    kept = complete_calls(calls, min_completeness)
    loci = entropies(kept).join(marker_dimension(calls, ploidy).select("locus", "ploidy").distinct(), "locus")
    return genotypes(kept.join(loci, "locus"), (), ("entropy", "ploidy"))


def barratt_pairs(calls: DataFrame, ploidy=None, min_completeness: float = 0.10, block: int = BLOCK, every: bool = False) -> DataFrame:
    """``(i, j, d)`` of comparable pairs: entropy-weighted heuristic distance, mean over common loci.

    With ``every`` all pairs, ``d`` being NaN without a common locus; ``barratt_matrix`` fills it.
    """
    return pair_rows(calls.sparkSession, _barratt_genotypes(calls, ploidy, min_completeness), lambda own, x, y: _barratt(own, x, y, every), block)


def _barratt(own: Genotypes, x: np.ndarray, y: np.ndarray, every: bool) -> tuple:
    total, common = np.zeros((len(x), len(y))), np.zeros((len(x), len(y)))
    for at, _, _, _, a, b, cx, cy in own.loci(x, y):
        many = own.locus["ploidy"][at] > 1
        na, nb, both = a.sum(1)[:, None], b.sum(1)[None, :], a @ b.T
        union, least = na + nb - both, np.minimum(na, nb)
        alone = np.where(union == 2, 4, np.where(union > 2, 1 + union, 0)) if many else np.where(union > 1, 1 + union, 0)
        credit = 3 * ((both == 1) & (least == 1) & (union > (2 if many else 1))) + 2 * ((both > 0) & (least > 1))
        delta = np.where(both == 0, np.where(least > 1, union, alone), 4 - credit)
        comparable = least > 0
        total += spread(np.where(comparable, own.locus["entropy"][at] * delta, 0), cx, cy)
        common += spread(comparable.astype(float), cx, cy)
    if every:
        return np.where(common > 0, total / np.maximum(common, 1), np.nan), None
    return total / np.maximum(common, 1), common > 0


def plucinski_pairs(calls: DataFrame, ploidy=None, epsilon: float = EPSILON, min_completeness: float = 0.10, block: int = BLOCK, every: bool = False) -> DataFrame:
    """``(i, j, d)`` of comparable pairs: expected number of loci copies not shared, from 0 to 2.

    Sums of log-likelihoods for two, one and no shared copies over the common loci; equal weights before. With
    ``every`` all pairs, 2 without a common locus.
    """
    kept = complete_calls(calls, min_completeness)
    shares = allele_shares(kept).select("locus", "marker", F.greatest("share", F.lit(1e-4)).alias("p"))
    loci = marker_dimension(calls, ploidy).select("locus", "marker", "ploidy")
    own = kept.join(shares, ["locus", "marker"]).join(loci, ["locus", "marker"]).select("seq_id", "locus", "marker", "p", "ploidy")

    return pair_rows(calls.sparkSession, genotypes(own, ("p",), ("ploidy",)), lambda shared, x, y: _plucinski(shared, x, y, epsilon, every), block)


def _plucinski(own: Genotypes, x: np.ndarray, y: np.ndarray, epsilon: float, every: bool) -> tuple:
    sums, called = np.zeros((3, len(x), len(y))), [(own.codes(z) >= 0).astype(float) for z in (x, y)]
    for at, marks, gx, gy, a, b, cx, cy in own.loci(x, y):
        freq = own.marker["p"][marks]
        na, nb = a.sum(1)[:, None], b.sum(1)[None, :]
        least, second = np.ones((len(gx), len(gy))), np.ones((len(gx), len(gy)))  # the rarest shared alleles
        for m in np.argsort(-freq, kind="stable"):
            where = np.ix_(np.flatnonzero(a[:, m]), np.flatnonzero(b[:, m]))
            second[where], least[where] = least[where], freq[m]
        shared = a @ b.T
        l0 = (a @ np.log(freq))[:, None] + (b @ np.log(freq))[None, :]
        rare = [np.where(s > 0, freq, np.inf).min(1) for s in (a, b)]
        comparable = (na > 0) & (nb > 0)
        none = np.log(epsilon * np.where(comparable, np.minimum(rare[0][:, None], rare[1][None, :]), 1))
        l1 = np.where(shared >= 1, l0 - np.log(least), none)
        l2 = l1 if own.locus["ploidy"][at] == 1 else np.where((na == 1) | (nb == 1), l1, np.where(shared >= 2, l0 - np.log(least) - np.log(second), none))
        for k, s in enumerate((l0, l1, l2)):
            sums[k] += spread(np.where(comparable, s, 0), cx, cy)
    common = called[0] @ called[1].T > 0
    e = np.exp(sums - sums.max(0))
    d = (e[1] + 2 * e[0]) / e.sum(0)
    return (np.where(common, d, 2.0), None) if every else (d, common)


def _greatest(spark: SparkSession, own: Genotypes, metric: Callable, block: int) -> float:
    """The greatest distance that isn't NaN; 1 where that is 0 or there is none."""

    def step(top: float, shared: Genotypes, bi: int, bj: int) -> float:
        d = metric(shared, *_block_pair(shared, bi, bj, block))
        upper = np.triu(np.ones(d.shape, bool), 1) if bi == bj else np.ones(d.shape, bool)
        return max(top, d[upper & ~np.isnan(d)].max(initial=0.0))

    tops = fold_pairs(spark, own, blocks_of(own.n, block), lambda _: 0.0, step, lambda top: pa.table({"d": [top]}), "d double")
    return tops.agg(F.max("d")).first()[0] or 1.0


def _block_pair(own: Genotypes, bi: int, bj: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.arange(b * block, min(own.n, (b + 1) * block)) for b in (bi, bj))


def barratt_matrix(calls: DataFrame, cut: Cut | None = None, ploidy=None, min_completeness: float = 0.10, block: int = BLOCK) -> DataFrame:
    """``(i, j, d)`` of all pairs: ``barratt_pairs``, and the greatest of them (1 where that is 0) without a common locus.

    The pairs are made twice, as that is less than to keep them: first only for the greatest.
    """
    own = _barratt_genotypes(calls, ploidy, min_completeness)
    top = _greatest(calls.sparkSession, own, lambda shared, x, y: _barratt(shared, x, y, True)[0], block)

    def metric(shared: Genotypes, x: np.ndarray, y: np.ndarray) -> tuple:
        d = _barratt(shared, x, y, True)[0]
        return np.where(np.isnan(d), top, d), None

    return pair_rows(calls.sparkSession, own, metric, block)


def with_ranks(rows: DataFrame, col: str, name: str, places: int = 12, cut: Cut | None = None) -> DataFrame:
    """The rows with ``name``: the average rank of ``col`` over the number of rows.

    Values are rounded first, as sums in another order would split ties. The distinct values are counted, and only they
    are put in order, in ranges.
    """
    cut = cut or Cut(rows.sparkSession)
    own = cut.write(rows.withColumn("_v", F.round(col, places)))
    ranks = value_counts(own, "_v", cut).select("_v", ((F.col("below") + (F.col("n") + 1) / 2) / F.col("total")).alias(name))
    return own.join(ranks, "_v").drop("_v")


def fractional_ranks(pairs: DataFrame, places: int = 12) -> DataFrame:
    """``(i, j, f)``: average rank of each distance over the number of pairs."""
    return with_ranks(pairs.select("i", "j", "d"), "d", "f", places).select("i", "j", "f")


def rank_ensemble(first: DataFrame, second: DataFrame) -> DataFrame:
    """``(i, j, d)``: mean of the fractional ranks of two metrics over the same pairs."""
    a = fractional_ranks(first).withColumnRenamed("f", "fa")
    b = fractional_ranks(second).withColumnRenamed("f", "fb")
    return a.join(b, ["i", "j"]).select("i", "j", ((F.col("fa") + F.col("fb")) / 2).alias("d"))


class _Ranked:
    """Both metrics as whole numbers of ``1 / scale``, and with ``ranks`` the mean of their fractional ranks."""

    def __init__(self, own: Genotypes, epsilon: float, every: bool, scale: int, block: int):
        self.own, self.epsilon, self.every, self.scale, self.block, self.top, self.ranks = own, epsilon, every, scale, block, 1.0, []

    def values(self, x: np.ndarray, y: np.ndarray) -> tuple:
        (first, keep), (second, _) = _barratt(self.own, x, y, self.every), _plucinski(self.own, x, y, self.epsilon, self.every)
        if self.every:
            first = np.where(np.isnan(first), self.top, first)
        return *(np.floor(v * self.scale + 0.5).astype(np.int64) for v in (first, second)), keep

    def rank(self, which: int, v: np.ndarray) -> np.ndarray:
        values, ranks = self.ranks[which]
        return ranks[np.searchsorted(values, v)]


def _count_values(spark: SparkSession, shared: _Ranked) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each metric its distinct values and their fractional ranks, from counts over all pairs."""

    def start(_: _Ranked) -> list:
        return [np.zeros(0, np.int64), np.zeros(0, np.int64)]

    def step(state: list, ranked: _Ranked, bi: int, bj: int) -> list:
        x, y = _block_pair(ranked.own, bi, bj, ranked.block)
        *values, keep = ranked.values(x, y)
        ok = np.triu(np.ones((len(x), len(y)), bool), 1) if bi == bj else np.ones((len(x), len(y)), bool)
        ok = ok if keep is None else ok & keep
        for k, v in enumerate(values):
            if (v := v[ok]).size:
                if (high := int(v.max()) + 1) > len(state[k]):
                    state[k] = np.concatenate([state[k], np.zeros(high - len(state[k]), np.int64)])
                state[k][:high] += np.bincount(v, minlength=high)
        return state

    def end(state: list) -> pa.Table:
        at = [np.flatnonzero(c) for c in state]
        return pa.table({"k": np.repeat(np.arange(2, dtype=np.int32), [len(a) for a in at]), "v": np.concatenate(at), "n": np.concatenate([c[a] for c, a in zip(state, at)])})

    rows = fold_pairs(spark, shared, blocks_of(shared.own.n, shared.block), start, step, end, "k int, v long, n long", per_core=1)
    rows = rows.groupBy("k", "v").agg(F.sum("n").alias("n")).toArrow().sort_by([("k", "ascending"), ("v", "ascending")])
    k, v, n = (rows.column(c).to_numpy() for c in ("k", "v", "n"))
    out = []
    for which in (0, 1):
        values, counts = v[k == which], n[k == which]
        out.append((values, (np.cumsum(counts) - counts + (counts + 1) / 2) / max(counts.sum(), 1)))
    return out


def rank_ensemble_of(calls: DataFrame, ploidy=None, epsilon: float = EPSILON, min_completeness: float = 0.10, every: bool = False, places: int = 6, block: int = BLOCK) -> DataFrame:
    """``rank_ensemble`` of ``barratt_pairs`` and ``plucinski_pairs``, or with ``every`` of the matrices, rounded to ``places``.

    The pairs are made twice and nowhere kept: first to count the values of each metric, of which there are at most
    ``10 ** places`` for each unit of distance, then with their ranks.
    """
    spark, kept = calls.sparkSession, complete_calls(calls, min_completeness)
    shares = allele_shares(kept).select("locus", "marker", F.greatest("share", F.lit(1e-4)).alias("p"))
    own = kept.join(shares, ["locus", "marker"]).join(marker_dimension(calls, ploidy), ["locus", "marker"]).join(entropies(kept), "locus")
    shared = _Ranked(genotypes(own, ("p",), ("entropy", "ploidy")), epsilon, every, 10**places, block)
    if every:
        shared.top = _greatest(spark, shared.own, lambda own, x, y: _barratt(own, x, y, True)[0], block)
    shared.ranks = _count_values(spark, shared)

    def each(ranked: _Ranked, bi: int, bj: int) -> Iterator[pa.RecordBatch]:
        x, y = _block_pair(ranked.own, bi, bj, block)
        first, second, keep = ranked.values(x, y)
        ok = np.triu(np.ones(first.shape, bool), 1) if bi == bj else np.ones(first.shape, bool)
        i, j = np.nonzero(ok if keep is None else ok & keep)
        d = (ranked.rank(0, first[i, j]) + ranked.rank(1, second[i, j])) / 2
        yield pa.RecordBatch.from_arrays([ranked.own.ids.take(pa.array(x[i])), ranked.own.ids.take(pa.array(y[j])), pa.array(d)], names=["i", "j", "d"])

    return over_pairs(spark, shared, blocks_of(shared.own.n, block), each, "i string, j string, d double")


def double_centred_of(spark: SparkSession, own: Genotypes, metric: Callable, block: int = BLOCK) -> DataFrame:
    """``double_centred`` of the distances that ``metric`` makes, twice: first for the means, then for the rows."""

    def step(sums: np.ndarray, shared: Genotypes, bi: int, bj: int) -> np.ndarray:
        x, y = _block_pair(shared, bi, bj, block)
        d2 = metric(shared, x, y) ** 2
        if bi == bj:
            np.fill_diagonal(d2, 0)
        else:
            sums[y] += d2.sum(0)
        sums[x] += d2.sum(1)
        return sums

    parts = fold_pairs(spark, own, blocks_of(own.n, block), lambda shared: np.zeros(shared.n), step, lambda s: pa.table({"k": np.arange(len(s)), "s": s}), "k long, s double", per_core=1)
    mean = parts.groupBy("k").agg(F.sum("s").alias("s")).toArrow().sort_by("k").column("s").to_numpy() / max(own.n, 1)
    grand = float(mean.mean()) if own.n else 0.0

    def each(shared: tuple, bi: int, bj: int) -> Iterator[pa.RecordBatch]:
        of, m = shared
        x, y = _block_pair(of, bi, bj, block)
        d = metric(of, x, y)
        if bi == bj:
            np.fill_diagonal(d, 0)
        g = (-0.5 * (d * d - m[x][:, None] - m[y][None, :] + grand)).ravel()
        i, j = of.ids.take(pa.array(np.repeat(x, len(y)))), of.ids.take(pa.array(np.tile(y, len(x))))
        for a, b in ((i, j), (j, i))[: 1 + (bi != bj)]:
            yield pa.RecordBatch.from_arrays([a, b, pa.array(g)], names=["i", "j", "g"])

    return over_pairs(spark, (own, mean), blocks_of(own.n, block), each, "i string, j string, g double")


def double_centred(pairs: DataFrame) -> DataFrame:
    """``(i, j, g)``, both orders and the diagonal: -1/2 (d² - row mean - column mean + grand mean)."""
    cut = Cut(pairs.sparkSession)
    pairs = cut.write(pairs.select("i", "j", "d"))
    both = pairs.unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "d"))
    ids = cut.write(both.select("i").distinct())
    full = both.unionByName(ids.select("i", F.col("i").alias("j"), F.lit(0.0).alias("d"))).withColumn("d2", F.col("d") * F.col("d"))
    n = ids.select(F.count("*").alias("n"))
    sums = cut.write(full.groupBy("i").agg(F.sum("d2").alias("s")).join(F.broadcast(n)).select("i", (F.col("s") / F.col("n")).alias("m")))
    grand = sums.select(F.avg("m").alias("g0"))
    return (
        full.join(sums, "i").join(sums.select(F.col("i").alias("j"), F.col("m").alias("mj")), "j").join(F.broadcast(grand))
        .select("i", "j", (-0.5 * (F.col("d2") - F.col("m") - F.col("mj") + F.col("g0"))).alias("g"))
    )
