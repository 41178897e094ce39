import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociforge.operators import distance, genotype_tree, hierarchy
from lociforge.session import Cut, open_cuts


@pytest.fixture(scope="module")
def calls(spark):
    rng = random.Random(3)
    # every locus is called, so that only equal genotypes are at distance 0 and the tree has one form
    kinds = [[(f"L{x}", f"L{x}_Hap_{rng.randrange(9)}") for x in range(12) for _ in range(rng.randrange(1, 3))] for _ in range(60)]
    rows = [(f"S{i:02d}", *c) for i in range(90) for c in set(kinds[i % 60 if i < 75 else 7])]  # equal genotypes, some of them often
    return spark.createDataFrame(rows, "seq_id string, locus string, marker string").cache()


@pytest.fixture(scope="module")
def pairs(calls):
    return distance.wibs_pairs(calls, min_completeness=0.0).cache()


@pytest.fixture(scope="module")
def own(calls):
    return distance.wibs_genotypes(calls, min_completeness=0.0)


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def as_dict(df, value="d"):
    return {(r["i"], r["j"]): r[value] for r in df.collect()}


def test_pairs_are_made_without_a_shuffle_or_a_table(calls, pairs):
    sequences = calls.select("marker", F.repeat("marker", 3).alias("sequence")).distinct()
    before = open_cuts()
    made = {
        "wibs": lambda b: distance.wibs_pairs(calls, None, 0.0, b), "snp": lambda b: distance.snp_pairs(calls, sequences, None, 0.0, b),
        "barratt": lambda b: distance.barratt_pairs(calls, None, 0.0, b), "plucinski": lambda b: distance.plucinski_pairs(calls, min_completeness=0.0, block=b),
    }
    for one in made.values():
        df = one(7)
        assert shuffles(df) == 0
        assert as_dict(df) == pytest.approx(as_dict(one(512)), abs=1e-12)
    assert open_cuts() == before and pairs.count() == 90 * 89 // 2 and pairs.filter("i >= j").count() == 0


def test_tree_of_genotypes_is_that_of_the_pairs(spark, own, pairs):
    cut = Cut(spark)
    tree, cophenetic = hierarchy.ward_tree(pairs, cut, with_cophenetic=True)
    want = [r["height"] for r in tree.orderBy("step").collect()]
    for rest, block in ((4096, 512), (3, 16)):
        before = open_cuts()
        got = genotype_tree.genotype_tree(spark, own, distance.wibs_distances, rest, block, 9)
        assert open_cuts() == before  # nothing was written
        rows = got.frame().orderBy("step").collect()
        assert [r["height"] for r in rows] == pytest.approx(want, abs=1e-9) and rows[-1]["size"] == own.n and rows[-1]["step"] == own.n - 2
        # every cut of it is one of the tree as a table
        for k in (2, 5):
            ids = pairs.select(F.col("i").alias("seq_id")).union(pairs.select("j"))
            assert {tuple(r) for r in got.cut(k).collect()} == {tuple(r) for r in hierarchy.cut_tree(got.frame(), ids, k, cut).collect()}
        for b in (16,):
            steps = genotype_tree.steps_within(spark, own, got, distance.wibs_distances, 0.3, k_max=90, block=b)
            assert {r["step"]: r["n"] for r in steps.collect()} == joined(got)
            assert genotype_tree.cophenetic_correlation(spark, own, got, distance.wibs_distances, b).first()[0] == pytest.approx(hierarchy.cophenetic_correlation(pairs, cophenetic).first()[0], abs=1e-6)


def joined(tree):
    """How many pairs each merge joins, those before the last that counts for all k being one."""
    size, out = {k: 1 for k in range(tree.n)}, {}
    for step, (a, b) in enumerate(zip(tree.left.tolist(), tree.right.tolist())):
        out[min(step, tree.n - 2)] = out.get(min(step, tree.n - 2), 0) + size[a] * size[b]
        size[a] += size.pop(b)
    return out


def test_clusters_of_genotypes_are_those_of_the_pairs(spark, own, pairs):
    gold = spark.createDataFrame([(f"S{i:02d}", str(i % 60)) for i in range(0, 75)] + [("none", "1")], "seq_id string, cluster_alias string")
    for mine, other in (
        (genotype_tree.knee_clusters(spark, own, distance.wibs_distances, rest=5), hierarchy.knee_clusters(pairs)),
        (genotype_tree.supervised_clusters(spark, own, distance.wibs_distances, gold, rest=5), hierarchy.supervised_clusters(pairs, gold)),
    ):
        assert mine[1] == other[1] and mine[2] == pytest.approx(other[2]) and mine[0].count() == 90


def test_ranks_of_all_pairs_are_counted(spark, calls):
    some = calls.filter("(ascii(substr(seq_id, 3, 1)) + ascii(substr(locus, 2, 1))) % 2 = 0 or seq_id > 'S50'")  # some have no common locus
    for every in (False, True):
        first = distance.barratt_matrix(some, Cut(spark), min_completeness=0.0) if every else distance.barratt_pairs(some, min_completeness=0.0)
        second = distance.plucinski_pairs(some, min_completeness=0.0, every=every)
        for block in (16, 512):
            before = open_cuts()
            got = distance.rank_ensemble_of(some, None, min_completeness=0.0, every=every, block=block)
            assert shuffles(got) == 0 and open_cuts() == before
            assert as_dict(got) == pytest.approx(as_dict(distance.rank_ensemble(*(x.withColumn("d", F.round("d", 6)) for x in (first, second)))), abs=1e-9)


def test_double_centring_without_a_table(spark, calls, pairs):
    before = open_cuts()
    own = distance.wibs_genotypes(calls, min_completeness=0.0)
    got = distance.double_centred_of(spark, own, distance.wibs_distances, block=16)
    assert shuffles(got) == 0 and open_cuts() == before
    assert as_dict(got, "g") == pytest.approx(as_dict(distance.double_centred(pairs), "g"), abs=1e-9)


def test_one_or_no_specimen(spark, calls):
    for n, some in ((1, calls.filter("seq_id = 'S00'")), (0, calls.limit(0))):
        own = distance.wibs_genotypes(some, min_completeness=0.0)
        tree = genotype_tree.genotype_tree(spark, own, distance.wibs_distances)
        assert own.n == n and tree.frame().count() == 0 and tree.cut(1).count() == n and distance.wibs_pairs(some).count() == 0
        assert genotype_tree.cophenetic_correlation(spark, own, tree, distance.wibs_distances).first()[0] is None
        assert genotype_tree.knee_clusters(spark, own, distance.wibs_distances)[0].count() == n
        assert np.array_equal(own.codes(np.arange(n)) >= 0, np.ones((n, own.n_loci), bool))


def test_few_near_pairs_are_finished_in_one_task(spark, own):
    want = genotype_tree.genotype_tree(spark, own, distance.wibs_distances)
    for held in (25, 100):  # from 25 clusters on in one task, and all in one task
        got = genotype_tree.genotype_tree(spark, own, distance.wibs_distances, 3, 16, 9, held)
        assert got.h2 == pytest.approx(want.h2, abs=1e-12) and got.total.tolist() == want.total.tolist()
        assert got.left.tolist() == want.left.tolist() and got.right.tolist() == want.right.tolist()


def test_chain_that_writes_no_columns():
    rng = np.random.default_rng(1)
    for n in (2, 3, 40, 300):
        points, size = rng.random((n, 4)), rng.integers(1, 4, n).astype(float)
        d = ((points[:, None] - points) ** 2).sum(2) * 2 * size[:, None] * size / (size[:, None] + size)
        np.fill_diagonal(d, np.inf)
        want, got = hierarchy._chain(d.copy(), size.copy(), np.zeros(n))[0], genotype_tree._chained(d.copy(), size.copy(), np.zeros(n))
        assert [m[:2] for m in got] == [m[:2] for m in want] and np.allclose([m[2:] for m in got], [m[2:] for m in want])


def test_distances_of_few_common_markers(spark, calls):
    some = calls.filter("(ascii(substr(seq_id, 3, 1)) + ascii(substr(locus, 2, 1))) % 2 = 0 or seq_id > 'S50'")  # some have no common locus
    own = distance.wibs_genotypes(some, min_completeness=0.0)
    got = as_dict(distance.wibs_pairs(some, min_completeness=0.0, block=16))
    named = spark.createDataFrame(list(got), "i string, j string")
    assert got == pytest.approx(as_dict(distance.wibs_of_pairs(named, some, Cut(spark), min_completeness=0.0)), abs=1e-12)
    x = np.arange(own.n)
    d = distance.wibs_distances(own, x, x)
    assert (np.diag(d) == 0).all() and 1.0 in d
