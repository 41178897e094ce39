import itertools
import random

import numpy as np
import pytest

from lociforge.llm import leakage, packing, subjects, text

SYLLABLES = ["ba", "de", "ko", "mi", "nu", "ra", "so", "ti", "ve", "zu"]


def vocabulary(rng, n):
    return ["".join(rng.choice(SYLLABLES) for _ in range(4)) + str(i % 7) for i in range(n)]


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def repeats(doc, passage, n=27, edits=2):
    """Some n successive passage words align with a stretch of the text; by plain dynamic programming."""
    for s in range(len(passage) - n + 1):
        window = passage[s : s + n]
        row = [0] * (len(doc) + 1)
        for i, x in enumerate(window, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(doc, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) <= edits:
            return True
    return False


def test_words():
    assert text.words("Der Präsi-\n  dent (Beifall) sagt: L'ÉTÉ [Unruhe\nim Saal] 12,5 – straße_x") == ["der", "prasident", "sagt", "l", "ete", "12", "5", "strasse", "x"]


def test_leaks_against_brute_force(spark):
    rng = random.Random(9)
    common = vocabulary(rng, 300)
    items = [(i, " ".join(rng.choice(common) for _ in range(rng.choice([26, 27, 40, 60]))), 0) for i in range(12)]
    stock = " ".join(rng.choice(common) for _ in range(15))  # a phrase of many items
    items = [(i, p if i % 3 else stock + " " + p, 0) for i, p, _ in items]
    docs = []
    for d in range(150):
        own = [rng.choice(common) for _ in range(rng.randrange(60))]
        if rng.random() < 0.7:
            part = rng.choice(items)[1].split()
            size = min(len(part), rng.choice([20, 25, 26, 27, 28, 30, 40]))
            at = rng.randrange(len(part) - size + 1)
            part = part[at : at + size]
            for _ in range(rng.randrange(5)):
                k = rng.randrange(len(part))
                part = [part[:k] + [rng.choice(common)] + part[k + 1 :], part[:k] + part[k + 1 :], part[:k] + [rng.choice(common)] + part[k:]][rng.randrange(3)]
            own = own + part + [rng.choice(common) for _ in range(rng.randrange(30))]
        elif rng.random() < 0.5:
            own += stock.split()
        docs.append((d, " ".join(own).upper() if d % 2 else ", ".join(own), "en"))
    docs += [(900, None, "en"), (901, "", "en"), (902, " ".join([rng.choice(common) for _ in range(200_000)] + items[5][1].split()), "en"), (None, items[5][1], "en")]
    want = {(d, i) for d, t, _ in docs[:150] for i, p, _ in items if repeats(text.words(t), text.words(p))} | {(902, 5)}
    got = leakage.leaked(spark.createDataFrame(docs + docs[:9], "doc_id long, text string, item_id string"), spark.createDataFrame([*items, (50, None, 0), (51, "", 0)], "item_id long, passage string, text int"))
    assert {tuple(r) for r in got.filter("doc_id <> 902 or item_id = 5").collect()} == want and len(want) > 20
    several = leakage.leaked(spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, passage string, text int"), max_words=100)
    assert {tuple(r) for r in several.filter("doc_id <> 902 or item_id = 5").collect()} == want
    fewer = leakage.leaked(spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, passage string, text int"), kinds=("wholes",))
    assert {tuple(r) for r in fewer.filter("doc_id <> 902 or item_id = 5").collect()} < want  # whole windows alone miss edited runs
    assert leakage.leaked(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, passage string")).count() == 0


def test_blocks_find_every_near_fingerprint():
    rng = random.Random(1)
    own = [text.word_hashes(vocabulary(rng, 60))[1] for _ in range(4)]
    passages = leakage.Passages(list(range(4)), own, 27, 2, 2)
    assert len(passages.parts.fp) == 4 * 52 and len(passages.wholes.fp) == 4 * 34
    for p in (passages.parts, passages.wholes):
        probe = np.array([f ^ np.uint64(sum(1 << b for b in rng.sample(range(64), rng.randrange(4)))) for f in p.fp for _ in range(3)], np.uint64)
        at, place, _ = p.candidates(probe)
        want = {(i, int(p.at[j])) for i, j in itertools.product(range(len(probe)), range(len(p.fp))) if int(probe[i] ^ p.fp[j]).bit_count() <= 2}
        assert set(zip(at.tolist(), place.tolist())) == want


def test_shingle_similarity_keeps_every_run_with_two_edits():
    rng = random.Random(4)
    common = vocabulary(rng, 40)
    hashes = lambda ws: (lambda c, h: h[c])(*text.word_hashes(ws))
    own = [[rng.choice(common) for _ in range(60)] for _ in range(5)]
    p = leakage.Passages(list(range(5)), [hashes(t) for t in own], 27, 2, 2)
    kept = 0
    for _ in range(300):
        k, start = rng.randrange(5), rng.randrange(34)
        run, places = own[k][start : start + 27], list(range(start, start + 27))
        for _ in range(2):
            i, kind = rng.randrange(1, len(run) - 1), rng.randrange(3)
            run, places = (run[:i] + ["new"] * (kind < 2) + run[i + (kind != 1) :], places[:i] + [None] * (kind < 2) + places[i + (kind != 1) :])
        doc = hashes(["a"] * 3 + run + ["z"] * 3)
        for i in (i for i, x in enumerate(places) if x is not None):
            good = p.similar(leakage.shingles(doc), np.array([3 + i]), np.array([61 * k + places[i]]), 3)
            assert good[0]
            kept += 1
        other = p.similar(leakage.shingles(doc), np.array([3 + 5]), np.array([61 * ((k + 1) % 5) + 20]), 3)
        assert not other[0]
    assert kept > 1000


def test_boundaries_are_optimal():
    rng = np.random.default_rng(2)
    for _ in range(15):
        lengths = np.sort(rng.choice(np.arange(1, 60), 9, replace=False))
        counts = rng.integers(1, 50, 9)

        def padding(bounds):
            return int((counts * (np.asarray(bounds)[np.searchsorted(bounds, lengths)] - lengths)).sum())

        for k in (1, 2, 3, 5):
            best = min(padding(list(c) + [lengths[-1]]) for c in itertools.combinations(lengths[:-1], k - 1))
            assert padding(packing.optimal_boundaries(lengths, counts, k)) == best


def test_packing(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "Straße", "naïve", "42"]) for _ in range(rng.choice([1, 3, 10, 40, 90, 150, 700]))), "x") for i in range(300)]
    docs += [(5, docs[5][1], "again"), (1000, None, ""), (1001, "", ""), (1002, "word " * 30_000, "")]
    boxes = [("s", 64, 1), ("m", 256, 1), ("none", 0, 1), ("null", None, 1), ("s", 64, 2)]
    packed = packing.pack(spark.createDataFrame(docs, "doc_id long, text string, tokens string"), spark.createDataFrame(boxes, "container_kind string, capacity_tokens int, kind int"), buckets=32)
    rows = packed.collect()
    encode = packing._encoding(open(packing.TOKENIZER, "rb").read()).encode_ordinary
    for kind, capacity in (("s", 64), ("m", 256)):
        own = [r for r in rows if r["container_kind"] == kind]
        used = {}
        for r in own:
            if r["container_no"] is not None:
                used[r["container_no"]] = used.get(r["container_no"], 0) + r["tokens"]
        assert max(used.values()) <= capacity and sorted(used) == list(range(1, len(used) + 1))
        pieces = {}
        for r in own:
            pieces.setdefault(r["doc_id"], []).append((r["token_from"], r["tokens"]))
        assert len(own) == len({(r["container_no"], r["doc_id"], r["piece_no"]) for r in own}) or 5 in pieces
        for d, t, _ in docs:
            n = len(encode(t or ""))
            if d != 5:
                got = sorted(pieces[d])
                assert sum(x for _, x in got) == n and (len(got) == 1 or n > capacity) and [f for f, _ in got] == [capacity * i for i in range(len(got))]
        assert sum(used.values()) / (capacity * len(used)) > 0.9
    assert {r["container_kind"] for r in rows} == {"s", "m"}
    assert {r["container_no"] for r in rows if r["doc_id"] in (1000, 1001)} == {None}
    df, kinds = spark.createDataFrame(docs, "doc_id long, text string, tokens string"), spark.createDataFrame(boxes, "container_kind string, capacity_tokens int, kind int")
    for r in packing.fill_report(packed, kinds).collect():
        assert r["fullest"] <= 256 and r["n_containers"] <= r["n_batches"] and 0.5 < r["batch_fill"] <= r["fill"] <= 1
    assert {tuple(r)[2:] for r in packing.faults(packed, kinds).collect()} == {(0, 0, 0)}
    rough = packing.pack(df, kinds, buckets=32, max_lengths=50)  # capacities beyond the number of lengths
    assert {tuple(r)[2:] for r in packing.faults(rough, kinds).collect()} == {(0, 0, 0)} and rough.count() == len(rows)
    assert min(r["fill"] for r in packing.fill_report(rough, kinds).collect()) > 0.8
    assert packing.vocabulary(spark, "file://" + packing.TOKENIZER) == packing.vocabulary(spark, packing.TOKENIZER)
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(boxes, "container_kind string, capacity_tokens int, kind int")).count() == 0


def corpus(rng, n):
    topics = {s: vocabulary(random.Random(s), 12) for s in ("law", "sport", "energy")}
    plain = "the and of to that is for not was with we you are by have this may like shall said told".split() + vocabulary(random.Random("x"), 30)
    docs, truth = [], {}
    for d in range(n):
        about = rng.sample(sorted(topics), rng.choice([0, 1, 1, 1, 2]))
        kinds = [a for a in about for _ in range(4)] + [None] * (4 if about else 8)
        if about and rng.random() < 0.3:
            kinds = kinds * 3 + [next(s for s in sorted(topics) if s not in about)]  # a passing mention
        rng.shuffle(kinds)
        lines = [" ".join(rng.choice(plain) for _ in range(6)) + (" " + " ".join(rng.choice(topics[k]) for _ in range(3)) if k else "") + "." for k in kinds]
        docs.append((d, " ".join(lines) + " (Hear, hear!)\nMr Boho: That is not so!\n" + lines[0], "x"))
        truth[d] = set(about)
    return docs, truth


def test_subjects_on_held_out_documents(spark):
    rng = random.Random(12)
    docs, truth = corpus(rng, 900)
    labels = [(d, s) for d in range(300) for s in (sorted(truth[d]) or [None])]
    labels = [(d, "sport" if s and rng.random() < 0.05 else (s.upper() + " " if s and d % 5 == 0 else s)) for d, s in labels] + [(1, "no such subject"), (None, "law")]
    docs += [(5000, None, ""), (5001, "", ""), (5002, "...", ""), (None, "x", "")]
    names = spark.createDataFrame([("law", "about"), ("sport", "about"), ("energy", "about"), ("energy", "again")], "subject string, about string")
    found = subjects.subjects_of(spark.createDataFrame(docs, "doc_id long, text string, subject string"), spark.createDataFrame(labels + labels[:20], "doc_id long, subject string"), names, 0).cache()
    got = {}
    for r in found.filter("n_about * 6 >= n_sentences").collect():
        got.setdefault(r["doc_id"], set()).add(r["subject"])
    held = range(300, 900)
    assert np.mean([got.get(d, set()) == truth[d] for d in held]) >= 0.9
    assert not {5000, 5001, 5002} & set(got)
    rates = {(r["subject"], r["share_bin"]): r["posterior"] for r in subjects.calibrated(found).collect()}
    assert all(0 <= p <= 1 for p in rates.values()) and max(rates.values()) > 0.8
    assert {r["subject"] for r in subjects.composition(found).collect()} == {"law", "sport", "energy"}


def test_subjects_without_labels_or_texts(spark):
    docs = spark.createDataFrame([(1, "The court met. The court rose.")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, subject string")
    names = spark.createDataFrame([("law",)], "subject string")
    assert subjects.subjects_of(docs, none, names).count() == 0
    assert subjects.subjects_of(docs.limit(0), none, names).count() == 0
    assert subjects.subjects_of(docs, none, names.limit(0)).count() == 0


def test_isotonic_never_falls():
    got = subjects.isotonic(np.array([1.0, 5, 2, 9]), np.array([10.0, 10, 10, 10]))
    assert got == pytest.approx([0.1, 0.35, 0.35, 0.9])


def test_composition_counts_documents_without_a_sentence_found(spark):
    schema = "doc_id long, subject string, n_sentences int, n_about int, share_bin int, labelled boolean"
    seen = [(d, "law", 10, 5, subjects.BINS // 2, d < 80) for d in range(100)]
    missed = [(100 + d, "law", 10, 0, -1, d < 20 if d < 100 else None) for d in range(1900)]
    row = subjects.composition(spark.createDataFrame(seen + missed, schema)).first()
    assert row["n_documents"] == 100 and row["n_about"] == 500 and abs(row["expected_documents"] - 460) < 20
    docs, truth = corpus(random.Random(2), 60)
    labels = [(d, s) for d in range(30) for s in (sorted(truth[d]) or [None])]
    names = spark.createDataFrame([("law",), ("sport",), ("energy",), ("art",)], "subject string")
    found = subjects.subjects_of(spark.createDataFrame(docs, "doc_id long, text string, subject string"), spark.createDataFrame(labels, "doc_id long, subject string"), names, 0, misses=True).cache()
    assert found.count() == 4 * 60 and found.filter("labelled is not null").count() == 4 * 30
    assert found.filter("(n_about = 0) <> (share_bin = -1)").isEmpty()
