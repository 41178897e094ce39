import random

import numpy as np

from lociforge.operators import typing
from lociforge.operators.loci import Loci
from lociforge.session import Cut


def is_alike(s, c, identity=0.75):
    most = max(len(s), len(c))
    return min(len(s), len(c)) / most >= 0.6 and sum(p == q for p, q in zip(s, c)) / most >= identity


def varied(rng, bases, share, letters="ACGT"):
    s = "".join(rng.choice(letters) if rng.random() < share else c for c in rng.choice(bases))
    return s[: len(s) - rng.randrange(len(s) // 3)] if rng.random() < 0.5 else s


def placed(rows):
    """The definition: the first locus begun before that is alike, else a new one."""
    centroids, out, begun = {}, {}, 0
    for hint, s, k in rows:
        locus = hint or next((x for x, c in centroids.items() if is_alike(s, c)), None)
        if not locus:
            begun += 1
            locus = f"Locus_{begun:02d}"
        centroids.setdefault(locus, s)
        out[k] = locus
    return out


def test_alike_sequences_are_those_of_the_definition():
    rng = random.Random(4)
    bases = ["".join(rng.choice("ACGT") for _ in range(n)) for n in (20, 63, 64, 65, 130, 300, 320, 610)]
    texts = sorted({varied(rng, bases, rng.choice((0.05, 0.3, 0.36)), "ACGTN") for _ in range(500)}, key=lambda s: rng.random())
    for identity in (0.75, 0.5, 1.0):
        loci = Loci(identity)
        loci.add(range(0, 200), texts[:200], ["a"] * 200)
        loci.add(range(200, 400), texts[200:400], ["b"] * 200)
        want = {k: [j for j in range(min(k, 400)) if is_alike(texts[k], texts[j], identity)] for k in range(len(texts))}
        asked = np.arange(100, len(texts))
        assert loci.first(asked, texts[100:]) == {int(k): want[k][0] for k in asked if want[k]}
        assert loci.every(asked, texts[100:], 3) == {int(k): want[k][:3] for k in asked if want[k]}
    assert loci.name(199) == "a" and loci.name(200) == "b" and Loci(0.75).first([1], ["ACGT"]) == {}


def test_loci_of_dense_families(spark, monkeypatch):
    rng = random.Random(6)
    bases = ["".join(rng.choice("ACGT") for _ in range(n)) for n in (60, 90)]
    rows = [(f"L{rng.randrange(4)}" if rng.random() < 0.1 else None, varied(rng, bases, 0.25), k) for k in range(200)]
    want = placed(rows)
    df = spark.createDataFrame([("S", *r) for r in rows], "seq_id string, locus string, sequence string, ord long").repartition(3)
    monkeypatch.setattr(typing, "ALIKE", 2)  # lists of alike ones end early, so blocks do
    assert {r["ord"]: r["locus"] for r in typing.assigned_loci(df, Cut(spark), leaders=32).collect()} == want


def test_rounds_do_not_follow_the_loci(spark):
    rng = random.Random(9)
    rows = [(None, "".join(rng.choice("ACGT") for _ in range(100)), k) for k in range(600)]
    df = spark.createDataFrame([("S", *r) for r in rows], "seq_id string, locus string, sequence string, ord long")
    cut = Cut(spark)
    got = {r["ord"]: r["locus"] for r in typing.assigned_loci(df, cut, leaders=8).collect()}
    assert got == {k: f"Locus_{k + 1:02d}" for k in range(600)}
    assert cut.count < 12  # a round for each 8 loci would be 75
