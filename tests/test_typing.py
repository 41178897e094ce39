import math
import random

import pytest
from pyspark.sql import functions as F

from lociforge.functions import names, sequences
from lociforge.operators import components, distance, hierarchy, metrics, ordering, sheet, typing
from lociforge.session import Cut


def calls(spark, rows):
    own = spark.createDataFrame([(s, m) for s, ms in rows.items() for m in ms], "seq_id string, marker string")
    return own.withColumn("locus", names.parse_locus(F.col("marker")))


def as_dict(df):
    return {(r["i"], r["j"]): r["d"] for r in df.collect()}


def test_locus_names(spark):
    cases = {
        "Cp_HSP70_a1": "Cp_HSP70_a1", "Cp_HSP90_H01_508B": "Cp_HSP90", "gp60_L752bp.H01_9180": "gp60", "Nu_378_PART_A_Hap_4": "Nu_378_PART_A", "Mt_Cmt_Junction_PART_A_Hap_1": "Mt_Cmt",
        "18S_L458bp.H01_8F96": "18S", "Nu_1_PART_A_NOVEL_3F2A1B": "Nu_1_PART_AF2A1B", "Nu_1_PART_A_NOVEL_A1B2C3": "Nu_1_PART_A_NOVEL_A1B2C3", " x_ ": "x",
    }
    df = spark.createDataFrame([(k,) for k in cases], "m string")
    assert {r["m"]: r["l"] for r in df.select("m", names.parse_locus(F.col("m")).alias("l")).collect()} == cases


def test_sequence_functions(spark):
    df = spark.createDataFrame([("ACGTAC", "ACCT"), ("AAAA", "AAAA"), ("", "ACG"), ("", "")], "a string, b string")
    a, b = F.col("a"), F.col("b")
    got = [tuple(r) for r in df.select(sequences.hamming(a, b), sequences.prefix_identity(a, b), sequences.contains_either(a, b)).collect()]
    assert got == [((1 + 2) / 6, 3 / 6, False), (0.0, 1.0, True), (1.0, 0.0, True), (0.0, 0.0, True)]
    one = spark.createDataFrame([("ttCCATCTACAGCGGGAACACTTAACACcc", "I5")], "s string, q string")
    row = one.select(sequences.trim_junction(F.col("s")), sequences.mean_phred(F.col("q")), sequences.is_junction_read(F.col("s"))).first()
    assert tuple(row) == ("GGGAACACTT", 30.0, True)


# The numbers of the tests by hand are fixed values of the definitions.


def test_wibs_by_hand(spark):
    own = calls(spark, {"S1": ["LocA_Hap_1", "LocB_Hap_1"], "S2": ["LocA_Hap_1", "LocB_Hap_2"], "S3": ["LocA_Hap_2"]})
    for block in (1024, 1):
        got = as_dict(distance.wibs_pairs(own, {"LocA": 1, "LocB": 2}, 0.0, block=block))
        assert got[("S1", "S2")] == pytest.approx(0.24264068711928537) and got[("S1", "S3")] == 1.0 and got[("S2", "S3")] == 1.0


def test_no_common_locus(spark):
    got = as_dict(distance.wibs_pairs(calls(spark, {"A": ["L1_Hap_1"], "B": ["L2_Hap_1"], "C": ["L1_Hap_1", "L2_Hap_1"]}), 1, 0.0))
    assert got[("A", "B")] == 1.0


def test_plucinski_by_hand(spark):
    own = calls(spark, {"S1": ["Nu_1_Hap_1", "Nu_2_Hap_1"], "S2": ["Nu_1_Hap_1", "Nu_2_Hap_1"], "S3": ["Nu_1_Hap_2", "Nu_2_Hap_2"]})
    got = as_dict(distance.plucinski_pairs(own, None, min_completeness=0.0))
    assert got[("S1", "S2")] == pytest.approx(0.772727, rel=1e-4) and got[("S1", "S3")] == pytest.approx(1.552873, rel=1e-4)


def test_barratt_gives_equal_single_alleles_the_disjoint_value(spark):
    got = as_dict(distance.barratt_pairs(calls(spark, {"S1": ["Nu_1_Hap_1"], "S2": ["Nu_1_Hap_1"], "S3": ["Nu_1_Hap_2"]}), None, 0.0))
    h = -(2 / 3 * math.log2(2 / 3) + 1 / 3 * math.log2(1 / 3))
    assert got[("S1", "S2")] == pytest.approx(4 * h) and got[("S1", "S3")] == pytest.approx(4 * h)


def test_snp_distance_follows_the_sequences(spark):
    seqs = spark.createDataFrame([("L1_H01", "A" * 100), ("L1_H02", "A" * 99 + "C"), ("L1_H03", "A" * 90 + "C" * 10)], "marker string, sequence string")
    got = as_dict(distance.snp_pairs(calls(spark, {"S1": ["L1_H01"], "S2": ["L1_H02"], "S3": ["L1_H03"], "S4": ["L1_H04"]}), seqs, None, 0.0))
    assert got[("S1", "S2")] == pytest.approx(0.01) and got[("S1", "S3")] == pytest.approx(0.1) and got[("S1", "S4")] == 1.0
    mixed = calls(spark, {"S1": ["L1_H01", "L2_H05"], "S2": ["L1_H02", "L1_H03"], "S3": ["L2_H06"], "S4": ["L2_H06", "L3_H01"]})
    for block in (1024, 1):
        got = as_dict(distance.snp_pairs(mixed, seqs, None, 0.0, block=block, every=True))
        assert got[("S1", "S2")] == pytest.approx(0.01) and got[("S1", "S3")] == 1.0 and got[("S2", "S3")] == 1.0 and got[("S3", "S4")] == 0.0 and len(got) == 6


def test_ranks_and_thresholds(spark):
    pairs = spark.createDataFrame([("A", "B", 0.1), ("A", "C", 0.3), ("B", "C", 0.2)], "i string, j string, d double")
    gold = spark.createDataFrame([("A", "1"), ("B", "1"), ("C", "1")], "seq_id string, cluster_alias string")
    assert metrics.gold_threshold(pairs, gold).first()["threshold"] == pytest.approx(0.64478)
    assert metrics.gold_threshold(pairs.limit(0), gold).first()["threshold"] == 0.05
    tied = spark.createDataFrame([("A", "B", 0.1), ("A", "C", 0.3), ("B", "C", 0.3)], "i string, j string, d double")
    assert sorted(r["f"] for r in distance.fractional_ranks(tied).collect()) == [1 / 3, 2.5 / 3, 2.5 / 3]
    other = spark.createDataFrame([("A", "1"), ("B", "1"), ("C", "2")], "seq_id string, cluster_alias string")
    assert metrics.distance_auc(tied, other).first()["auc"] == 1.0
    assert metrics.adjusted_rand(other, other.withColumnRenamed("cluster_alias", "b"), "cluster_alias", "b").first()["ari"] == 1.0


def naive_ward(d, n):
    size, alive, out = {i: 1 for i in range(n)}, set(range(n)), []
    d = {k: v * v for k, v in d.items()}
    get = lambda a, b: d[(min(a, b), max(a, b))]
    while len(alive) > 1:
        a, b = min(((x, y) for x in alive for y in alive if x < y), key=lambda p: (get(*p), p))
        h = get(a, b)
        out.append(math.sqrt(h))
        for k in alive - {a, b}:
            d[(min(a, k), max(a, k))] = ((size[a] + size[k]) * get(a, k) + (size[b] + size[k]) * get(b, k) - size[k] * h) / (size[a] + size[b] + size[k])
        size[a] += size[b]
        alive.discard(b)
    return out


def test_ward_and_selection(spark):
    rng = random.Random(5)
    points = [(c * 10 + rng.random(), rng.random()) for c in range(2) for _ in range(6)]
    d = {(i, j): math.dist(points[i], points[j]) for i in range(12) for j in range(i + 1, 12)}
    pairs = spark.createDataFrame([(f"S{i:02d}", f"S{j:02d}", v) for (i, j), v in d.items()], "i string, j string, d double")
    cut = Cut(spark)
    tree, cophenetic = hierarchy.ward_tree(pairs, cut, with_cophenetic=True)
    assert sorted(r["height"] for r in tree.collect()) == pytest.approx(sorted(naive_ward(d, 12)))
    assert cophenetic.count() == 66
    for rest in (1, 3):  # all rounds, and a bounded rest in one task
        again, met = hierarchy.ward_tree(pairs, cut, with_cophenetic=True, rest=rest)
        assert sorted(r["height"] for r in again.collect()) == pytest.approx(sorted(r["height"] for r in tree.collect()))
        assert {(r["i"], r["j"]): round(r["height"], 9) for r in met.collect()} == {(r["i"], r["j"]): round(r["height"], 9) for r in cophenetic.collect()}
    labels, k, _ = hierarchy.knee_clusters(pairs, cut)
    assert k == 2 and {r["seq_id"]: r["label"] for r in labels.collect()} == {f"S{i:02d}": 1 + i // 6 for i in range(12)}
    gold = spark.createDataFrame([(f"S{i:02d}", str(i // 6)) for i in range(12)], "seq_id string, cluster_alias string")
    assert hierarchy.supervised_clusters(pairs, gold, cut)[1] == 2


def test_ward_with_many_equal_items(spark):
    rng = random.Random(7)
    points = [(0.0, 0.0)] * 60 + [(9.0, 1.0)] * 5 + [(rng.random(), rng.random()) for _ in range(9)]
    n = len(points)
    d = {(i, j): math.dist(points[i], points[j]) for i in range(n) for j in range(i + 1, n)}
    pairs = spark.createDataFrame([(f"S{j:02d}", f"S{i:02d}", v) for (i, j), v in d.items()], "i string, j string, d double")
    cut = Cut(spark)
    want = sorted(naive_ward(d, n))
    for rest in (4, 1024):
        tree, cophenetic = hierarchy.ward_tree(pairs, cut, with_cophenetic=True, rest=rest)
        rows = tree.orderBy("step").collect()
        assert [r["height"] for r in rows] == pytest.approx(want, abs=1e-7) and [r["step"] for r in rows] == list(range(n - 1)) and rows[-1]["size"] == n
        assert cophenetic.count() == n * (n - 1) // 2
        assert sum(r["height"] ** 2 for r in rows) == pytest.approx(2 / n * sum(v * v for v in d.values()))
    assert hierarchy.ward_tree(pairs.limit(0), cut)[0].count() == 0
    one = pairs.limit(1)
    assert hierarchy.ward_tree(one, cut)[0].count() == 1
    alike = spark.createDataFrame([("a", "b", 1.0), ("a", "c", 1.0), ("b", "c", 1.0)], "i string, j string, d double")  # ties
    assert [r["height"] for r in hierarchy.ward_tree(alike, cut, rest=1)[0].orderBy("step").collect()] == pytest.approx([1.0, math.sqrt(1)])
    gaps = {r["k"]: r["gap"] for r in hierarchy.height_gaps(tree, 3).collect()}
    assert sorted(gaps) == [2, 3] and gaps[2] == pytest.approx(want[-1] - want[-2])


def test_order_in_ranges(spark):
    rng = random.Random(2)
    values = [round(rng.random(), 2) for _ in range(501)] + [None]
    df = spark.createDataFrame([(v,) for v in values], "d double").repartition(5)
    got = {r["d"]: (r["n"], r["below"], r["total"]) for r in ordering.value_counts(df.filter("d is not null"), "d").collect()}
    known = sorted(v for v in values if v is not None)
    assert got == {v: (known.count(v), sum(x < v for x in known), 501) for v in known}
    assert ordering.exact_median(df, "d") == known[250] and ordering.exact_median(df.limit(0), "d") is None
    even = spark.createDataFrame([(float(x),) for x in (1, 2, 4, 9)], "d double")
    assert ordering.exact_median(even, "d") == 3.0
    names = [f"x{i:04d}" for i in range(300)]
    df = spark.createDataFrame([(s,) for s in rng.sample(names, 300)], "s string").repartition(6)
    assert {r["s"]: r["no"] for r in ordering.numbered(df, ["s"], "no", start=1).collect()} == {s: i + 1 for i, s in enumerate(names)}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(300 + i, 301 + i) for i in range(40)] + [(0, 400 + i) for i in range(100)] + [(7, 7)]
    got = {r["node"]: r["comp"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long"), Cut(spark)).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    assert got == {x: find(x) for x in list(parent)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long"), Cut(spark)).count() == 0


def test_sheet_and_frequencies(spark):
    own = calls(spark, {"S1": ["L1_Hap_1", "L2_Hap_1"], "S2": ["L1_Hap_1"], "S3": ["L1_Hap_2", "L3_Hap_1"]})
    wide = sheet.presence_sheet(own)
    assert wide.columns == ["Seq_ID", "L1_Hap_1", "L1_Hap_2", "L2_Hap_1", "L3_Hap_1"] and wide.first().asDict()["L1_Hap_2"] == ""
    assert {tuple(r) for r in sheet.melt_sheet(wide).collect()} == {tuple(r) for r in own.select("seq_id", "marker").collect()}
    assert {r["seq_id"] for r in sheet.complete_calls(own, 0.5).collect()} == {"S1", "S3"}
    p = {r["marker"]: (r["carriers"], r["called"], r["p"]) for r in sheet.allele_frequencies(own, sheet.marker_dimension(own)).collect()}
    assert p["L1_Hap_1"] == (2, 3, pytest.approx(2 / 3)) and p["L2_Hap_1"] == (1, 1, 1 - 1e-4)


def test_contigs_and_reads(spark):
    rng = random.Random(2)
    ref = "".join(rng.choice("ACGT") for _ in range(100))
    refs = spark.createDataFrame([(1, "L1_Hap_1", ref), (2, "L1_Hap_2", ref[:50] + "A" * 50)], "ref_ord long, marker string, sequence string")
    changed = ref[:60] + ("C" if ref[60] != "C" else "G") * 1 + ref[61:]
    contigs = spark.createDataFrame([(1, ref), (2, ref[5:95]), (3, changed), (4, "T" * 30), (5, ref[:80] + "".join(rng.choice("ACGT") for _ in range(20)))], "ord long, sequence string")
    got = {r["ord"]: r["marker"] for r in typing.match_contigs(contigs, refs).collect()}
    assert got[1] == got[2] == got[3] == "L1_Hap_1" and got[4].startswith("Novel_Marker_") and got[5].startswith("L1_NOVEL_")
    reads = spark.createDataFrame([("s", i, "TT" + ref, "I" * 102) for i in range(5)] + [("s", 9, "G" * 40, "!" * 40)], "sample_id string, rec_no long, sequence string, qual string")
    assert [tuple(r) for r in typing.read_support(reads, refs.filter("ref_ord = 1")).collect()] == [("s", "L1_Hap_1", 99.5, 5, 50)]
    assert typing.filter_reads(reads, 30, 200).count() == 5
    votes = spark.createDataFrame([("k", 1, "ACGT"), ("k", 2, "ACCT"), ("k", 3, "AGGTT")], "k string, rec_no long, sequence string")
    assert votes.transform(lambda d: typing.consensus(d, "k")).first()["consensus"] == "ACGT"
    ranked = spark.createDataFrame([("a", "L", "ACGT" * 6, 1), ("b", "L", "ACGT" * 7, 2), ("a", "L", "ACGT" * 7, 3)], "seq_id string, locus string, sequence string, ord long")
    assert [r["rank"] for r in typing.haplotype_ranks(ranked).orderBy("len").collect()] == [2, 1]


def test_contigs_without_hint_get_the_locus_their_sequence_tells(spark):
    rng = random.Random(8)
    bases = ["".join(rng.choice("ACGT") for _ in range(n)) for n in (60, 60, 80, 45, 100)]
    vary = lambda s: "".join(rng.choice("ACGT") if rng.random() < 0.15 else c for c in s)[: len(s) - rng.randrange(6)]
    rows = []
    for k in range(160):
        b = rng.randrange(5)
        rows.append((f"S{k % 20}", rng.choice([None, "", f"L{b}"]) if b < 2 and k > 9 else None, vary(bases[b]) if rng.random() < 0.7 else bases[b], k))
    centroids, want, begun = {}, {}, 0
    for _, hint, s, k in rows:
        locus = hint or next((x for x, c in centroids.items() if min(len(s), len(c)) / max(len(s), len(c)) >= 0.6 and sum(p == q for p, q in zip(s, c)) / max(len(s), len(c)) >= 0.75), None)
        if not locus:
            begun += 1
            locus = f"Locus_{begun:02d}"
        centroids.setdefault(locus, s)
        want[k] = locus
    df = spark.createDataFrame(rows, "seq_id string, locus string, sequence string, ord long").repartition(3)
    for leaders in (4, 2048):
        assert {r["ord"]: r["locus"] for r in typing.assigned_loci(df, Cut(spark), leaders=leaders).collect()} == want
    assert begun > 2 and {r[0] for r in typing.denovo_calls(typing.assigned_loci(df, Cut(spark))).select("seq_id").distinct().collect()} == {r[0] for r in rows}


def test_pairs_without_a_common_locus_are_in_the_matrix(spark):
    own = calls(spark, {"A": ["Nu_1_Hap_1", "Nu_2_Hap_1"], "B": ["Nu_1_Hap_2", "Nu_2_Hap_1"], "C": ["Nu_3_Hap_1"], "D": ["Nu_3_Hap_2", "Nu_1_Hap_1"]})
    apart = {("A", "C"), ("B", "C")}
    some = as_dict(distance.barratt_pairs(own))
    first = distance.barratt_matrix(own, Cut(spark))
    second = distance.plucinski_pairs(own, every=True)
    every = {(a, b) for a in "ABCD" for b in "ABCD" if a < b}
    assert set(some) == every - apart and as_dict(first) == pytest.approx(some | {p: max(some.values()) for p in apart})
    assert as_dict(second) == pytest.approx(as_dict(distance.plucinski_pairs(own)) | {p: 2.0 for p in apart})
    ranks = as_dict(distance.rank_ensemble(first, second))
    assert set(ranks) == every and all(ranks[p] == max(ranks.values()) for p in apart)


def test_wibs_of_given_pairs(spark):
    rng = random.Random(5)
    own = calls(spark, {f"S{i:02d}": sorted({f"L{rng.randrange(6)}_Hap_{rng.randrange(4)}" for _ in range(rng.randrange(1, 9))}) for i in range(20)})
    every = {(r["i"], r["j"]): r["d"] for r in distance.wibs_pairs(own, min_completeness=0.3).collect()}
    asked = [(f"S{i:02d}", f"S{j:02d}") for i in range(20) for j in range(i + 1, 20) if (i + j) % 3 == 0] + [("S01", "none")]
    got = distance.wibs_of_pairs(spark.createDataFrame(asked, "i string, j string"), own, Cut(spark), min_completeness=0.3)
    want = {k: every[k] for k in asked if k in every}
    found = {(r["i"], r["j"]): r["d"] for r in got.collect()}
    assert want and found == pytest.approx(want) and any(v == 1.0 for v in want.values())
