"""Subjects of documents: complement naive Bayes, refined by expectation-maximisation, with calibrated posteriors.

1. Texts become sentences of hashed words (language and word share a feature); interruptions and heckling are left out. A
   text's language is told by its own words, whose rates by language are learned from the ``lang`` of sampled documents.
2. Complement naive Bayes on the labelled documents: a word's weight for a subject is the log of its rate in the
   subject's documents over its rate in all others of the language. A weight counts only if the ratio is at least
   ``MIN_RATIO`` and stands out from chance, so words of common phrases weigh nothing.
3. Each round finds the posterior of every subject, and of none, for each sentence of every document, unlabelled ones too, with
   the document's own shares as a prior; the sums of these posteriors are the expected subjects of the document's words in
   the next model. Posteriors under ``LEAST_POSTERIOR`` are left to none: spread over the phrases of all speeches, they would
   make a subject of these.
4. The share of a document's sentences that are about a subject gets its meaning as a probability for each subject by itself:
   isotonic regression over share bins on the labelled documents, with the rule of ``MIN_SHARE`` as a weak prior. A document's
   subjects are those whose posterior is at least one half.

The model is a table of ``FEATURES`` hashed words by subjects, whatever the corpus. The word counts of a round are summed
inside tasks, of which there are at most ``COUNT_TASKS``, then by Spark; only the bounded sums reach the driver.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociforge.llm.text import BRACKETED, BROKEN, WORD, distinct_words, plain, slices, word_hashes
from lociforge.session import Cut

HECKLE = re.compile(r"(?<=\n)[^\n:.!?]{2,40}:\s[^.!?:]{1,60}\s?[!?]+[ \t]*(?=\n|\Z)")
SENTENCE_END = re.compile(r"(?:(?<=[.!?…])|(?<=[.!?…][\"»”]))(?<!\b[^\W\d_]\.)\s+")
FEATURES = 1 << 18
MAX_LABELLED = 200_000
MAX_SUBJECTS = 60
MIN_COUNT = 5
MIN_RATIO = 4.0
MIN_Z = 2.5
MIN_LABELLED = 5
MIN_RATE = 0.2
PRIOR = 50.0
NONE_SCORE = 3.0
ROUNDS = 3
MIN_SHARE = 1 / 6
BINS = 24
SLICE = 2_000_000
LANGUAGE_SAMPLE = 5000
MIN_LANGUAGE = 0.01
SAME_LANGUAGE = 0.5
LEAST_POSTERIOR = 0.5
COUNT_TASKS = 4000
RULE_WEIGHT = 4.0
RULE_RATE = 0.9


def sentences(text: str) -> list[list[str]]:
    """Words of each sentence: three letters or more, no numbers. Brackets and heckled lines are left out."""
    if "-" in text:
        text = BROKEN.sub("", text)
    if "(" in text or "[" in text:
        text = BRACKETED.sub(" ", text)
    if ":" in text:
        text = HECKLE.sub(" ", text)
    return [w for w in map(WORD.findall, SENTENCE_END.split(plain(text))) if w]


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (((hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - 18)).astype(np.int32)


def language_weights(documents: DataFrame, sample: int = LANGUAGE_SAMPLE) -> np.ndarray:
    """A weight of each hashed word for each language, from about ``sample`` documents with a ``lang``, picked by hash.

    ``lang`` is read lower-case; values of less than ``MIN_LANGUAGE`` of the sample don't count, nor do those whose words are
    those of a commoner one. A word weighs the log of its rate in the language over its mean rate, so a wrong ``lang`` here and
    there does not matter. Without a ``lang`` column there is one language.
    """
    if "lang" not in documents.columns:
        return np.zeros((FEATURES, 0), np.float32)
    own = documents.select(F.lower(F.btrim("lang")).alias("lang"), "text", "doc_id").filter("lang <> '' and text is not null")
    n = own.count()
    own = own.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < math.ceil((1 << 20) * min(1.0, sample / max(n, 1)))).select("lang", "text")
    by_lang = own.groupBy("lang").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))
    names = [r["lang"] for r in by_lang.filter(F.col("share") >= MIN_LANGUAGE).orderBy(F.desc("n"), "lang").limit(int(1 / MIN_LANGUAGE)).collect()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            lists = [WORD.findall(plain(t)) for t in batch.column("text").to_pylist()]
            codes, hashes = word_hashes([w for t in lists for w in t])
            owner = np.repeat([names.index(x) for x in batch.column("lang").to_pylist()], [len(t) for t in lists]).astype(np.int64)
            at, counts = np.unique((owner << 18) | _bucket(hashes)[codes], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array((at >> 18).astype(np.int32)), pa.array((at & (FEATURES - 1)).astype(np.int32)), pa.array(counts)], names=["k", "f", "n"])

    rates = np.zeros((FEATURES, len(names)))
    if names:
        got = own.filter(F.col("lang").isin(names)).mapInArrow(run, "k int, f int, n long").groupBy("k", "f").agg(F.sum("n").alias("n")).toArrow()  # at most FEATURES by the languages
        rates[got.column("f").to_numpy(), got.column("k").to_numpy()] = got.column("n").to_numpy()
    known = rates.sum(1) >= MIN_COUNT
    kept: list[int] = []
    root = np.sqrt(rates / np.maximum(rates.sum(0), 1))
    for k in range(len(names)):
        if all(root[:, k] @ root[:, j] < SAME_LANGUAGE for j in kept):
            kept.append(k)
    rates = rates[:, kept] + 0.5
    rates /= rates.sum(0)
    weights = np.log(rates / rates.mean(1, keepdims=True))
    return np.where(known[:, None], np.clip(weights, -3, 3), 0).astype(np.float32)


def featured(documents: DataFrame, labels: DataFrame, languages: np.ndarray) -> DataFrame:
    """``(doc_id, mask, language, lengths, features, firsts)``: words per sentence and hashed words of each document with a sentence.

    ``mask`` has a bit for each labelled subject, none for a label without subject, and is null without a label.
    ``language`` is a column of ``languages``, or their number where the words tell none. ``firsts`` marks the first of a word
    in the document.
    """
    n_languages = languages.shape[1]
    shared = documents.sparkSession.sparkContext.broadcast(languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            flat: list[str] = []
            counts: list[list[int]] = []
            for t in batch.column("text").to_pylist():
                own = sentences(t or "")
                counts.append([len(w) for w in own])
                for w in own:
                    flat.extend(w)
            codes, names, hashes = distinct_words(flat)
            docs = len(counts)
            owner = np.repeat(np.arange(docs), np.array([sum(c) for c in counts], np.int64))
            usable = np.array([len(w) > 2 and not w[0].isdigit() for w in names], bool)
            told = shared.value[_bucket(hashes)]
            votes = np.stack([np.bincount(owner, weights=told[:, k][codes], minlength=docs) for k in range(n_languages)] or [np.zeros(docs)], 1)
            language = np.where(votes.max(1) > 0, votes.argmax(1), n_languages)
            keep = usable[codes] if len(flat) else np.empty(0, bool)
            feature = _bucket(hashes[codes] + language[owner].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))[keep]
            in_doc = owner[keep]
            bits = len(feature).bit_length()
            key = np.sort((((in_doc << 18) | feature) << bits) | np.arange(len(feature)))
            firsts = np.zeros(len(key), bool)
            firsts[key[np.r_[True, key[1:] >> bits != key[:-1] >> bits]] & ((1 << bits) - 1) if len(key) else key] = True
            sentence = np.repeat(np.arange(sum(map(len, counts))), np.array([n for c in counts for n in c], np.int64))
            lengths = np.bincount(sentence[keep], minlength=sum(map(len, counts))).astype(np.int32)
            at = np.r_[0, np.cumsum([len(c) for c in counts])].astype(np.int32)
            kept = np.r_[0, np.cumsum(np.bincount(in_doc, minlength=docs))].astype(np.int32)
            lists = [pa.ListArray.from_arrays(at, pa.array(lengths)), pa.ListArray.from_arrays(kept, pa.array(feature)), pa.ListArray.from_arrays(kept, pa.array(firsts))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mask"), pa.array(language.astype(np.int32)), *lists], names=["doc_id", "mask", "language", "lengths", "features", "firsts"])

    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text is not null")
    schema = "doc_id long, mask long, language int, lengths array<int>, features array<int>, firsts array<boolean>"
    return own.join(F.broadcast(labels), "doc_id", "left").select("doc_id", "mask", "text").mapInArrow(run, schema)


class Model:
    """Weights of the features that say something, by subject."""

    def __init__(self, counts: np.ndarray, language: np.ndarray, n: int, labelled: np.ndarray | None = None):
        """``counts``: features by subjects and, last, all; ``language``: of each feature; ``labelled``: counts by label."""
        total = counts[:, n]
        weights = np.zeros((len(counts), n))
        for lang in np.unique(language):
            at = np.flatnonzero((language == lang) & (total >= MIN_COUNT))
            if not len(at):
                continue
            c, t = counts[at, :n], total[at][:, None]
            prior = PRIOR * t / t.sum()
            inside, outside = c + prior, t - c + prior
            ratio = (inside / inside.sum(0)) / (outside / outside.sum(0))
            expected = t * (c.sum(0) / t.sum())
            z = (c - expected) / np.sqrt(expected + 0.5)
            weights[at] = np.where((ratio >= MIN_RATIO) & (z >= MIN_Z), np.log(ratio), 0)
        if labelled is not None:
            # a word that the clerks' documents know well keeps no subject that they rarely give it
            known = labelled[:, n] >= MIN_LABELLED
            weights[known] = np.where(labelled[known, :n] + 1 >= MIN_RATE * (labelled[known, n:] + 2), weights[known], 0)
        useful = np.flatnonzero(weights.any(1))
        self.place = np.zeros(len(counts), np.int32)
        self.place[useful] = np.arange(1, len(useful) + 1)
        self.weights = np.r_[np.zeros((1, n)), weights[useful]].astype(np.float32)

    def posteriors(self, lengths: np.ndarray, per_doc: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(sentence, doc, p)``: the posterior of each subject for each sentence that holds a weighty word.

        The others have no subject whatever the prior.
        """
        n = self.weights.shape[1]
        row = self.place[features]
        at = np.flatnonzero(row)
        sentence = np.repeat(np.arange(len(lengths)), lengths)[at]
        score = np.zeros((len(lengths), n), np.float32)
        if len(at):
            first = np.flatnonzero(np.r_[True, sentence[1:] != sentence[:-1]])
            score[sentence[first]] = np.add.reduceat(self.weights[row[at]], first, axis=0)
        told = np.flatnonzero(score.any(1))
        doc = np.repeat(np.arange(len(per_doc)), per_doc)[told]
        score = score[told]
        share, p = np.full((len(per_doc), n), 1 / n), score
        for _ in range(3):
            z = score + np.log(share[doc] * n)
            top = np.maximum(z.max(1), NONE_SCORE) if len(z) else np.empty(0)
            p = np.exp(z - top[:, None])
            p /= p.sum(1, keepdims=True) + np.exp(NONE_SCORE - top)[:, None]
            share = np.full((len(per_doc), n), 0.2)
            for k in range(n):
                share[:, k] += np.bincount(doc, weights=p[:, k], minlength=len(per_doc))
            share /= share.sum(1, keepdims=True)
        return told, doc, p


def _flat(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    col = batch.column(name)
    return col.flatten().to_numpy(zero_copy_only=False), np.diff(col.offsets.to_numpy())


def word_counts(table: DataFrame, n: int, model) -> tuple[np.ndarray, np.ndarray]:
    """``(counts, language)``: expected documents with each feature by subject, from the labels or from a broadcast model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((n + 1) * FEATURES)
        language = np.zeros(FEATURES, np.int32)
        for batch in batches:
            if not batch.num_rows:
                continue
            lengths, per_doc = _flat(batch, "lengths")
            features, words = _flat(batch, "features")
            docs = batch.num_rows
            if model is None:
                mask = batch.column("mask").to_numpy(zero_copy_only=False).astype(np.int64)
                share = ((mask[:, None] >> np.arange(n)) & 1).astype(float)
                used = np.ones(docs)
            else:
                _, doc, p = model.value.posteriors(lengths, per_doc, features)
                share = np.zeros((docs, n))
                for k in range(n):
                    share[:, k] = np.bincount(doc, weights=np.where(p[:, k] >= LEAST_POSTERIOR, p[:, k], 0), minlength=docs)
                nothing = pa.compute.fill_null(pa.compute.equal(batch.column("mask"), 0), False).to_numpy(zero_copy_only=False)
                share[nothing] = 0  # clerks found no subject
                # a document counts in full once a whole sentence is expected to have a subject, else by that expectation
                share /= np.maximum(share.sum(1), 1)[:, None]
                used = np.where(nothing, 1, share.sum(1))
            once, _ = _flat(batch, "firsts")  # a word counts once in a document, however often it is repeated
            owner, features = np.repeat(np.arange(docs), words)[once], features[once]
            language[features] = batch.column("language").to_numpy()[owner]
            starts = np.r_[0, np.cumsum(np.bincount(owner, minlength=docs))]
            share = np.concatenate([share, used[:, None]], 1)
            # the words of each document once for each of its subjects, and once for all
            doc, k = np.nonzero(share)
            size = starts[doc + 1] - starts[doc]
            at = np.repeat(starts[doc] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            sums += np.bincount(np.repeat(k * FEATURES, size) + features[at], weights=np.repeat(share[doc, k], size), minlength=len(sums))
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array((at % FEATURES).astype(np.int32)), pa.array((at // FEATURES).astype(np.int32)), pa.array(language[at % FEATURES]), pa.array(sums[at])], names=["f", "k", "language", "w"])

    # at most FEATURES * (subjects + 1) rows from each of a bounded number of tasks, and as many in all
    got = table.coalesce(COUNT_TASKS).mapInArrow(run, "f int, k int, language int, w double").groupBy("f", "k").agg(F.sum("w").alias("w"), F.max("language").alias("language")).toArrow()
    counts, language = np.zeros((FEATURES, n + 1)), np.zeros(FEATURES, np.int32)
    f = got.column("f").to_numpy()
    counts[f, got.column("k").to_numpy()] = got.column("w").to_numpy()
    language[f] = got.column("language").to_numpy()
    return counts, language


def subject_names(subjects: DataFrame) -> list[str]:
    names = [r[0] for r in subjects.select("subject").filter("subject is not null").distinct().orderBy("subject").limit(MAX_SUBJECTS + 1).collect()]
    if len(names) > MAX_SUBJECTS:
        raise ValueError(f"more than {MAX_SUBJECTS} subjects")
    return names


def label_masks(labels: DataFrame, names: list[str], max_labelled: int = MAX_LABELLED) -> DataFrame:
    """``(doc_id, mask)`` of at most ``max_labelled`` labelled documents, picked by hash. Unknown subjects don't count."""
    bits = {name.strip().lower(): 1 << i for i, name in enumerate(names)}
    spelt = F.lower(F.btrim(F.col("subject"), F.lit(" \t\r\n")))
    bit = F.when(spelt.isNull() | (spelt == ""), F.lit(0).cast("long"))
    for name, value in bits.items():
        bit = bit.when(spelt == name, F.lit(value).cast("long"))
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), bit.alias("bit")).filter("doc_id is not null and bit is not null")
    return own.groupBy("doc_id").agg(F.bit_or("bit").alias("mask")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)


def fit(table: DataFrame, n: int, rounds: int = ROUNDS):
    """The broadcast model after the labelled documents and ``rounds`` rounds over all."""
    context = table.sparkSession.sparkContext
    labelled, language = word_counts(table.filter("mask is not null"), n, None)
    shared = context.broadcast(Model(labelled, language, n, labelled))
    for _ in range(rounds):
        shared = context.broadcast(Model(*word_counts(table, n, shared), n, labelled))
    return shared


def sentence_counts(table: DataFrame, model, n: int) -> DataFrame:
    """``(doc_id, mask, n_sentences, hits array<int>)``: each document's sentences, and those of each subject."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lengths, per_doc = _flat(batch, "lengths")
            features, _ = _flat(batch, "features")
            _, doc, p = model.value.posteriors(lengths, per_doc, features)
            docs, sure, k = batch.num_rows, np.nonzero(p > 0.5)[0], np.nonzero(p > 0.5)[1]
            hits = np.bincount(doc[sure] * n + k, minlength=docs * n).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("mask"), pa.array(per_doc.astype(np.int32)), pa.ListArray.from_arrays(np.arange(docs + 1, dtype=np.int32) * n, pa.array(hits))],
                names=["doc_id", "mask", "n_sentences", "hits"],
            )

    return table.mapInArrow(run, "doc_id long, mask long, n_sentences int, hits array<int>")


def subjects_of(documents: DataFrame, labels: DataFrame, subjects: DataFrame, min_share: float = MIN_SHARE, cut: Cut | None = None, misses: bool = False) -> DataFrame:
    """``(doc_id, subject, n_sentences, n_about, share_bin, labelled)`` of each subject a document's sentences are about.

    ``documents``: ``(doc_id, text)``, and ``lang`` where there is one; ``labels``: ``(doc_id, subject)``; ``subjects``: ``(subject)``; further columns
    are ignored. Only subjects of at least ``min_share`` of the sentences have a row (0: all that occur). With
    ``misses`` each document also has a row, of bin -1, for every subject that none of its sentences is about. Null and empty
    texts have none; neither has anything without labels to learn from. Repeated labels count once; of repeated
    ``doc_id`` each row is a document of its own.
    """
    cut = cut or Cut(documents.sparkSession)
    names = subject_names(subjects)
    if not names:
        return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit("").alias("subject"), F.lit(0).alias("n_sentences"), F.lit(0).alias("n_about"), F.lit(0).alias("share_bin"), F.lit(None).cast("boolean").alias("labelled")).limit(0)
    table = cut.write(featured(documents, label_masks(labels, names), language_weights(documents)))
    counted = sentence_counts(table, fit(table, len(names)), len(names))
    counted = cut.write(counted)  # read twice, by the calibration and for the rows
    each = counted.select("doc_id", "mask", "n_sentences", F.posexplode("hits").alias("k", "n_about"))
    floor = max(1, round(1 / min_share)) if min_share else None
    enough = F.col("n_about") * floor >= F.col("n_sentences") if floor else F.lit(True)
    hit = (F.col("n_about") > 0) & enough
    return each.filter(hit | (F.col("n_about") == 0) if misses else hit).select(
        "doc_id",
        F.element_at(F.array(*[F.lit(s) for s in names]), F.col("k") + 1).alias("subject"),
        "n_sentences",
        "n_about",
        F.when(F.col("n_about") == 0, -1).otherwise(F.floor(F.col("n_about") * BINS / F.col("n_sentences"))).cast("int").alias("share_bin"),
        F.when(F.col("mask").isNotNull(), F.expr("(shiftright(mask, k) & 1) = 1")).alias("labelled"),
    )


def isotonic(hits: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Non-decreasing rates closest to ``hits / counts``: neighbours that fall are pooled."""
    blocks: list[list[float]] = []
    for h, c in zip(hits, counts):
        blocks.append([h, c, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            h2, c2, m = blocks.pop()
            blocks[-1][0] += h2
            blocks[-1][1] += c2
            blocks[-1][2] += m
    return np.concatenate([np.full(int(m), h / c) for h, c, m in blocks])


def calibrated(found: DataFrame) -> DataFrame:
    """``found`` (of ``min_share`` 0) with ``posterior``: how likely a clerk gives the subject at this share.

    For each subject by itself, on the labelled documents, with the rates of all subjects as a prior worth ten documents; these
    have the rule itself (at least ``MIN_SHARE`` of the sentences) as a prior worth ``RULE_WEIGHT``. Documents without a
    sentence about the subject (bin -1) have a rate of their own, apart from the shares. At most ``BINS + 2`` rows a subject
    reach the driver.
    """
    rows = found.filter("labelled is not null").groupBy("subject", "share_bin").agg(F.count("*").alias("n"), F.sum(F.col("labelled").cast("long")).alias("h")).collect()
    n = {}
    for r in rows:
        n.setdefault(r["subject"], np.zeros((2, BINS + 2)))[:, r["share_bin"] + 1] = r["h"], r["n"]
    pool = sum(n.values()) if n else np.zeros((2, BINS + 2))
    rule = np.where(np.arange(BINS + 1) >= math.ceil(round(BINS * MIN_SHARE, 9)), RULE_RATE, 1 - RULE_RATE)
    rates = lambda h, c: np.append(h[0] / c[0], isotonic(h[1:], c[1:]))
    base = rates(pool[0] + RULE_WEIGHT * np.r_[1 - RULE_RATE, rule], pool[1] + RULE_WEIGHT)
    fitted = {s: rates(v[0] + 10 * base, v[1] + 10) for s, v in n.items()}
    curve = found.sparkSession.createDataFrame([(s, i - 1, float(x)) for s, v in fitted.items() for i, x in enumerate(v)], "subject string, share_bin int, posterior double")
    other = F.element_at(F.array(*[F.lit(float(x)) for x in base]), F.col("share_bin") + 2)
    return found.join(F.broadcast(curve), ["subject", "share_bin"], "left").withColumn("posterior", F.coalesce("posterior", other))


def likely(found: DataFrame) -> DataFrame:
    """The rows of ``found`` (of ``min_share`` 0) whose calibrated posterior is at least one half."""
    return calibrated(found).filter("posterior >= 0.5")


def composition(found: DataFrame) -> DataFrame:
    """``(subject, n_documents, n_about, expected_documents)``: the corpus by subject.

    ``n_documents`` counts those that are likely to treat it. ``found`` has its misses, else the documents that treat a
    subject unnoticed aren't expected.
    """
    return calibrated(found).groupBy("subject").agg(
        F.sum(((F.col("n_about") > 0) & (F.col("posterior") >= 0.5)).cast("long")).alias("n_documents"), F.sum("n_about").alias("n_about"), F.round(F.sum("posterior"), 3).alias("expected_documents")
    )
