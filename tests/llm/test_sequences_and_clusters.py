import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociforge.llm import markov_clusters, near_duplicates
from lociforge.session import Cut


def groups_of(pairs, nodes):
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in nodes}


def edited(rng, s, n):
    s = list(s)
    for _ in range(n):
        k = rng.randrange(len(s))
        kind = rng.random()
        if kind < 0.4:
            s[k] = rng.choice("ACGT")
        elif kind < 0.7:
            s.insert(k, rng.choice("ACGT"))
        elif len(s) > 25:
            del s[k]
    return "".join(s)


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(4)
    bases = ["".join(rng.choice("ACGT") for _ in range(rng.choice([20, 40, 150, 300]))) for _ in range(25)]
    rows = [(i, edited(rng, rng.choice(bases), rng.choice([0, 0, 1, 2, 4, 8])), "x") for i in range(220)]
    rows += [(1000 + i, bases[3], "copy") for i in range(60)]  # a hot group of copies
    rows += [(2000, None, ""), (2001, "", ""), (2002, "ACGT", ""), (2003, "-" + bases[5].lower()[:10] + "\n" + bases[5][10:], ""), (2004, "".join(rng.choice("ACGT") for _ in range(60_000)), "")]
    df = spark.createDataFrame(rows + rows[:5], "rec_no long, sequence string, key string")
    got = {r["rec_no"]: r["group_no"] for r in near_duplicates.near_duplicate_groups(df).collect()}
    clean = {n: "".join(c for c in (s or "").upper() if c in "ACGT") for n, s, _ in rows}
    sets = {n: {s[i : i + 8] for i in range(len(s) - 7)} for n, s in clean.items() if len(s) >= 20}
    near = [(a, b) for a in sets for b in sets if a < b and 10 * len(sets[a] & sets[b]) >= 6 * len(sets[a] | sets[b])]
    assert got == groups_of(near, sets)
    assert near_duplicates.near_duplicate_groups(df.limit(0)).count() == 0


def test_sketch_agrees_like_jaccard():
    rng = np.random.default_rng(1)
    t, pairs, agree, want = 256, 60, [], []
    for _ in range(pairs):
        union = rng.choice(65536, 200, replace=False)
        shared = union[: rng.integers(20, 200)]
        rest = union[len(shared) :]
        a, b = np.concatenate([shared, rest[::2]]), np.concatenate([shared, rest[1::2]])
        s = near_duplicates.sketch(np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), 2, t)
        assert (s != near_duplicates.EMPTY).all()
        agree.append((s[0] == s[1]).mean())
        want.append(len(shared) / len(union))
    assert abs(np.mean(agree) - np.mean(want)) < 0.02 and np.corrcoef(agree, want)[0, 1] > 0.97
    few = near_duplicates.sketch(np.array([5]), np.array([0]), 2, t)
    assert (few[0] != near_duplicates.EMPTY).all() and (few[1] == near_duplicates.EMPTY).all()


def alike(a, b):
    common = a.keys() & b.keys()
    return len(common) >= 16 and sum(bool(a[x] & b[x]) for x in common) * 10 >= 8 * len(common)


def test_clusters_against_brute_force(spark):
    rng = random.Random(6)
    loci = [f"Nu_L{i}" for i in range(24)]
    lineages = [{x: rng.randrange(6) for x in loci} for _ in range(8)]
    specimens = {}
    for i in range(130):
        line = lineages[0] if i < 50 else rng.choice(lineages)  # a hot cluster
        specimens[f"S_{i:03d}"] = {x: {rng.randrange(6) if rng.random() < 0.08 else h} | ({rng.randrange(6)} if rng.random() < 0.05 else set()) for x, h in line.items() if rng.random() < 0.85}
    specimens["S_FEW"] = {x: {lineages[0][x]} for x in loci[:10]}
    specimens["S_WIDE"] = {x: set(range(6)) for x in loci}  # shares a marker with all
    rows = [(f" {s.lower().replace('_', '-')}\t", None if rng.random() < 0.2 else x, f"{x}_Hap_{h}", 0) for s, g in specimens.items() for x, hs in g.items() for h in hs]
    rows += rows[:40] + [(None, "a", "a_Hap_1", 0), ("S_000", "a", None, 0), ("", "a", "a_Hap_1", 0)]
    df = spark.createDataFrame(rows, "seq_id string, locus string, marker string, node int")
    want = groups_of([(a, b) for a in specimens for b in specimens if a < b and alike(specimens[a], specimens[b])], specimens)
    want = {(g, s) for s, g in want.items() if s != g}
    assert {tuple(r) for r in markov_clusters.found(df).collect()} == want
    cut = Cut(spark)
    graph = markov_clusters.alike_graph(markov_clusters.genotypes(df, cut), cut)
    few = markov_clusters.alike_graph(markov_clusters.genotypes(df, cut), cut, wide_keys=100)  # many are wide
    assert few.wide is not None and few.links(cut).count() == graph.links(cut).distinct().count()
    assert {tuple(r) for r in markov_clusters.markov_clusters(few, cut)[0].filter("seq_id <> first_seq_id").select("first_seq_id", "seq_id").collect()} == want
    _, described = markov_clusters.markov_clusters(graph, cut)
    rows = described.collect()
    assert sum(r["n_members"] - 1 for r in rows) == len(want) and all(1 <= len(r["typical"]) <= 3 for r in rows)
    assert markov_clusters.found(df.limit(0)).count() == 0


def test_equal_genotypes_are_a_cluster_only_with_enough_loci(spark):
    many = [(s, f"L{i}", f"L{i}_Hap_1") for s in "AB" for i in range(16)]
    few = [(s, f"L{i}", f"L{i}_Hap_2") for s in "CD" for i in range(15)]
    df = spark.createDataFrame(many + few, "seq_id string, locus string, marker string")
    assert {tuple(r) for r in markov_clusters.found(df).collect()} == {("A", "B")}


def test_combinations_guarantee_a_common_bucket():
    for loci in (16, 24, 32, 60, 200):
        k, m = markov_clusters._plan(loci, 13)
        assert 13 > m * (k - 1)
        rng = random.Random(loci)
        for _ in range(200):
            shared = rng.sample(range(loci), 13)
            assert max(sum(x % m == g for x in shared) for g in range(m)) >= k


def test_flow_separates_weakly_joined_groups(spark):
    edges = [(a, b, 1.0) for base in (0, 10) for a in range(base, base + 6) for b in range(a + 1, base + 6)] + [(5, 10, 0.1)]
    links = spark.createDataFrame(edges, "a long, b long, sim double")
    for dense in (2048, 2):  # as a matrix in a task, and as joins
        home = {r["node"]: r["cluster"] for r in markov_clusters.flow_clusters(links, Cut(spark), dense=dense).collect()}
        assert home == {x: 0 for x in range(6)} | {x: 10 for x in range(10, 16)}
        merged = markov_clusters.merged_clusters(markov_clusters.flow_clusters(links, Cut(spark), dense=dense), links, Cut(spark))
        assert {(r["node"], r["merged"]) for r in merged.collect()} == {(x, 0) for x in home}
    with pytest.raises(Exception, match="did not settle"):
        markov_clusters.flow_clusters(links, Cut(spark), max_iterations=1).collect()


def test_typical_against_brute_force_flow(spark):
    rng = random.Random(3)
    loci = [f"Nu_L{i}" for i in range(20)]
    specimens = {}
    for i in range(70):  # one clique with more links than 1 / PRUNE, in an order that tells nothing, and copies
        specimens[f"A_{(i * 37) % 70:03d}"] = {x: {0} for x in loci} | {x: {1 + i} for x in rng.sample(loci, rng.choice([0, 1, 1, 2, 2, 3]))}
    specimens |= {f"A_{100 + i}": specimens["A_005"] for i in range(3)}
    specimens |= {f"B_{i:02d}": {x: {500} for x in loci} | {x: {600 + i} for x in loci[i : i + 1 + i % 3]} for i in range(8)}
    ids = sorted(specimens)
    link = lambda a, b: sum(bool(a[x] & b[x]) for x in loci) / len(loci) if alike(a, b) else 0.0
    v = np.array([[link(specimens[a], specimens[b]) if a != b else 0.0 for b in ids] for a in ids])
    v0 = v > 0
    np.fill_diagonal(v, v.max(0))
    v, early = v / v.sum(0), None
    for _ in range(30):
        v = (v @ v) ** 2
        v /= v.sum(0)
        early = v.sum(1) if early is None else early
    home = groups_of([(a, b) for i, a in enumerate(ids) for j, b in enumerate(ids) if i < j and v0[i, j]], ids)
    limit, early = dict(zip(ids, v.sum(1).round(6))), dict(zip(ids, early.round(6)))
    want = {h: sorted((s for s in ids if home[s] == h), key=lambda s: (-limit[s], -early[s], s))[:3] for h in set(home.values())}
    df = spark.createDataFrame([(s, x, f"{x}_Hap_{h}") for s, g in specimens.items() for x, hs in g.items() for h in hs], "seq_id string, locus string, marker string")
    cut = Cut(spark)
    graph = markov_clusters.alike_graph(markov_clusters.genotypes(df, cut), cut)
    at = {r["seq_id"]: r["node"] for r in graph.members.collect()}
    want_links = {tuple(sorted((at[a], at[b]))) for i, a in enumerate(ids) for j, b in enumerate(ids) if i < j and v0[i, j] and at[a] != at[b]}
    assert {(r["a"], r["b"]) for r in graph.links(cut).collect()} == want_links
    _, described = markov_clusters.markov_clusters(graph, cut)
    assert {r["first_seq_id"]: r["typical"] for r in described.collect()} == want
    again = df.repartition(7, "locus")
    _, described = markov_clusters.markov_clusters(markov_clusters.alike_graph(markov_clusters.genotypes(again, cut), cut), cut)
    assert {r["first_seq_id"]: r["typical"] for r in described.collect()} == want
    # the rounds of large components: the same links and, but for pruning, the same flow
    links = graph.links(cut, dense=2)
    assert links.count() == len(want_links)
    first = markov_clusters.flow_clusters(links, cut, weights=graph.members.groupBy("node").count().withColumnRenamed("count", "m"), dense=2, prune=0.0)
    assert all(abs(early[s] - r) < 1e-5 for r, s in ((r["inflow"], s) for r in first.collect() for s in ids if at[s] == r["node"]))
    large, _ = markov_clusters.markov_clusters(graph, cut, dense=2)
    small, _ = markov_clusters.markov_clusters(graph, cut)
    assert {tuple(r) for r in large.collect()} == {tuple(r) for r in small.collect()}
