"""Haplotype calls from contigs and reads."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociforge.functions.identifiers import clean_id
from lociforge.functions.names import JUNCTION_LOCUS, content_hash, haplotype_id, junction_id
from lociforge.functions.sequences import is_junction_read, mean_phred, plain_sequence, trim_junction
from lociforge.operators.loci import Loci
from lociforge.operators.ordering import numbered
from lociforge.session import Cut

MIN_LETTERS = 20
SEED = 20
LOCUS_IDENTITY = 0.75
LEADERS = 4096
ALIKE = 64
MATCH_ROWS = 2048
MATCH_LETTERS = 2_000_000
#: Parts of the names of sequences without an equal reference; fixed values.
NOVEL = "_NOVEL_"
NOVEL_MARKER = "Novel_Marker_"


def contig_view(contigs: DataFrame) -> DataFrame:
    """``(seq_id, locus_hint, sequence, ord)`` with cleaned ids and plain sequences of 20 letters or more."""
    return contigs.select(clean_id("seq_id").alias("seq_id"), clean_id("locus_hint").alias("locus_hint"), plain_sequence(F.col("sequence")).alias("sequence"), "ord").filter(F.length("sequence") >= MIN_LETTERS)


def assigned_loci(contigs: DataFrame, cut: Cut, identity: float = LOCUS_IDENTITY, leaders: int = LEADERS) -> DataFrame:
    """``(seq_id, locus, sequence, ord)``: the contigs, those without a locus with the one their sequence tells.

    ``contigs``: ``(seq_id, locus, sequence, ord)``, the locus null or blank where unknown. In the order of ``ord`` a
    contig without locus gets the first locus begun before it whose first sequence agrees with it in ``identity`` of the
    letters of the longer one, place by place; else it begins ``Locus_NN``. Equal sequences get one locus, so distinct
    ones are compared, and only with first sequences. They go in blocks in order, the first of ``leaders`` and each next
    one as large as all before, so rounds follow the logarithm of the sequences: a block is compared with the loci begun
    before it, what is left with itself, and the few alike pairs of that tell what begins. The driver, and each task,
    holds the first sequences of the loci.
    """
    spark = contigs.sparkSession
    known = F.coalesce(F.col("locus"), F.lit("")) != ""
    hinted, blank = contigs.filter(known), contigs.filter(~known)
    first = hinted.groupBy("locus").agg(F.min_by("sequence", "ord").alias("sequence"), F.min("ord").alias("at"))
    open_ = blank.groupBy("sequence").agg(F.min("ord").alias("at")).withColumn("locus", F.lit(None).cast("string"))
    with Cut(spark) as step:
        order = [F.col("at"), F.col("locus").isNull(), F.col("sequence"), F.col("locus")]
        nodes = cut.write(numbered(first.unionByName(open_), order, "no", step).select("no", "sequence", "locus"))
    total, parts, loci = nodes.count(), 2 * spark.sparkContext.defaultParallelism, Loci(identity)
    told, own, begun, start = [], [], 0, 0

    def decided(rows: DataFrame) -> DataFrame:
        """``(no, sequence, locus, told)``: the rows, those told by a locus with its name and without their sequence."""
        shared = spark.sparkContext.broadcast(loci)

        def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                free = pdf[pdf["locus"].isna()]
                found = shared.value.first(free["no"], free["sequence"])
                names = [shared.value.name(found[no]) if no in found else None for no in pdf["no"]]
                yield pdf.assign(sequence=[None if n else s for n, s in zip(names, pdf["sequence"])], told=names)

        out = cut.write(rows.mapInPandas(decide, "no long, sequence string, locus string, told string"))
        shared.destroy()
        return out

    def alike(rows: DataFrame, among: Loci) -> dict[int, list[int]]:
        shared = spark.sparkContext.broadcast(among)

        def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                met = shared.value.every(pdf["no"], pdf["sequence"], ALIKE)
                yield pd.DataFrame({"no": pd.Series(list(met), dtype="int64"), "others": pd.Series(list(met.values()), dtype=object)})

        met = rows.select("no", "sequence").mapInPandas(compare, "no long, others array<long>").collect()
        shared.destroy()
        return {r["no"]: r["others"] for r in met}

    while start < total:
        end = min(total, start + max(leaders, start))
        block = decided(nodes.filter(F.col("no").between(start, end - 1)).repartition(parts, "no"))
        rest = block.filter("told is null")
        left = sorted((r["no"], r["sequence"], r["locus"]) for r in rest.collect())
        among = Loci(identity)
        among.add([r[0] for r in left], [r[1] for r in left], [])
        met = alike(rest.filter("locus is null"), among)
        new: dict[int, tuple[str, str]] = {}
        for no, sequence, locus in left:
            others = met.get(no, []) if locus is None else []
            of = next((k for k in others if k in new), None)
            if of is not None:
                own.append((no, new[of][1]))
                continue
            if len(others) == ALIKE:  # more may follow, of which one may have begun a locus: the next block starts here
                end = no
                break
            if locus is None:
                begun += 1
                locus = f"Locus_{begun:02d}"
                own.append((no, locus))
            new[no] = (sequence, locus)
        loci.add(list(new), [s for s, _ in new.values()], [n for _, n in new.values()])
        told.append(block.filter((F.col("no") < end) & F.col("told").isNotNull()).select("no", F.col("told").alias("locus")))
        start = end
    names = cut.write(spark.createDataFrame(own, "no long, locus string"))
    for found in told:
        names = names.unionByName(found)
    done = nodes.filter("locus is null").select("no", "sequence").join(names, "no").select("sequence", "locus")
    return hinted.select("seq_id", "locus", "sequence", "ord").unionByName(blank.drop("locus").join(done, "sequence").select("seq_id", "locus", "sequence", "ord"))


def haplotype_ranks(contigs: DataFrame) -> DataFrame:
    """``(locus, sequence, n, len, rank, marker)``: a locus's sequences by records, then length, then first seen.

    ``contigs``: ``(seq_id, locus, sequence, ord)``. Records are counted, so repeats of a specimen count.
    """
    n = contigs.groupBy("locus", "sequence").agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"))
    rank = F.row_number().over(Window.partitionBy("locus").orderBy(F.desc("n"), F.desc(F.length("sequence")), "first_ord"))
    return n.select("locus", "sequence", "n", F.length("sequence").alias("len"), rank.alias("rank")).withColumn("marker", haplotype_id(F.col("locus"), F.col("sequence"), F.col("rank")))


def denovo_calls(contigs: DataFrame) -> DataFrame:
    """``(seq_id, locus, marker)``: each specimen's haplotypes, named by locus, length, rank and content."""
    ranks = haplotype_ranks(contigs).select("locus", "sequence", "marker")
    return contigs.join(ranks, ["locus", "sequence"]).select("seq_id", "locus", "marker").distinct()


def _in_parts(rows: DataFrame, text: str) -> DataFrame:
    """The rows with ``part`` and ``parts``: each length bucket ``lb`` in parts of a bounded number of rows and letters."""
    sizes = rows.groupBy("lb").agg(F.greatest(F.ceil(F.count("*") / MATCH_ROWS), F.ceil(F.sum(F.length(text)) / MATCH_LETTERS)).cast("int").alias("parts"))
    return rows.join(sizes, "lb").withColumn("part", F.pmod(F.xxhash64(text), "parts").cast("int"))


def _best_references(contigs: pd.DataFrame, refs: pd.DataFrame, min_coverage: float) -> pd.DataFrame:
    """For each contig of a block the best of the block's references with enough coverage, if any."""
    out = []
    if len(contigs) and len(refs):
        refs = refs.sort_values("ref_ord", ignore_index=True)
        texts, names, order = refs["rs"].tolist(), refs["ref"].tolist(), refs["ref_ord"].to_numpy()
        lengths = np.array([len(t) for t in texts])
        letters = np.zeros((len(texts), lengths.max()), np.uint8)
        for k, t in enumerate(texts):
            letters[k, : len(t)] = np.frombuffer(t.encode(), np.uint8)
        for s in contigs["sequence"]:
            n = len(s)
            cov = 100.0 * np.minimum(lengths, n) / np.maximum(lengths, n)
            near = np.flatnonzero(cov >= min_coverage)
            if not len(near):
                continue
            exact = next((k for k in near if texts[k] in s or s in texts[k]), None)
            if exact is not None:
                out.append((s, names[exact], int(order[exact]), float(cov[exact]), 100.0, True))
                continue
            own = np.frombuffer(s.encode(), np.uint8)[: letters.shape[1]]
            equal = (letters[near, : len(own)] == own).sum(1)  # places after a reference's end hold no letter
            ident = 100.0 * equal / np.minimum(lengths[near], n)
            k = int(ident.argmax())  # the first of equal ones
            out.append((s, names[near[k]], int(order[near[k]]), float(cov[near[k]]), float(ident[k]), False))
    return pd.DataFrame(out, columns=["sequence", "ref", "ref_ord", "cov", "ident", "exact"])


def match_contigs(contigs: DataFrame, references: DataFrame, min_identity: float = 99.0, min_coverage: float = 85.0) -> DataFrame:
    """``(ord, marker, identity_pct, coverage_pct)``: each contig's best reference haplotype.

    ``contigs``: ``(ord, sequence)``; ``references``: ``(ref_ord, marker, sequence)``; neither has to fit anywhere. A
    contained sequence with enough coverage counts as identical, the first in order winning; else the greatest identity
    with enough coverage. Below ``min_identity`` the marker is a novel one of the best one's locus, without any candidate
    a novel marker. Equal contigs are compared once. The coverage bounds the ratio of lengths, so contigs meet the
    references of their own and the neighbouring length buckets, in blocks of bounded size, and each block's best ones
    are compared after.
    """
    s = F.col("sequence")
    step = -math.log(min_coverage / 100.0) if min_coverage < 100 else 1e-9
    bucket = lambda c: F.floor(F.log(F.length(c).cast("double")) / step).cast("long")
    queries = contigs.select("sequence").distinct()
    own = _in_parts(queries.filter(F.length("sequence") > 0).withColumn("lb", bucket("sequence")), "sequence")
    refs = references.select("ref_ord", F.col("marker").alias("ref"), F.col("sequence").alias("rs")).filter(F.length("rs") > 0)
    refs = refs.withColumn("lb", F.explode(F.array(*[bucket("rs") + k for k in (-1, 0, 1)])))
    refs = _in_parts(refs, "rs")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    ref_parts, own_parts = refs.select("lb", F.col("parts").alias("n")).distinct(), own.select("lb", F.col("parts").alias("n")).distinct()
    left = own.join(ref_parts, "lb").withColumn("other", every("n")).select("lb", "part", "other", "sequence")
    right = refs.join(own_parts, "lb").withColumn("other", every("n")).select("lb", F.col("other").alias("part"), F.col("part").alias("other"), "ref_ord", "ref", "rs")
    scored = left.groupBy("lb", "part", "other").cogroup(right.groupBy("lb", "part", "other")).applyInPandas(
        lambda a, b: _best_references(a, b, min_coverage), "sequence string, ref string, ref_ord long, cov double, ident double, exact boolean"
    )
    best = scored.groupBy("sequence").agg(F.min_by(F.struct("ref", "cov", "ident"), F.struct(~F.col("exact"), -F.col("ident"), "ref_ord")).alias("b"))
    known = queries.join(best, "sequence", "left")
    ref = F.col("b.ref")
    locus = F.when(ref.contains("_Hap_"), F.substring_index(ref, "_Hap_", 1)).when(ref.contains("Junction"), F.lit(JUNCTION_LOCUS)).otherwise(ref)
    novel = F.concat(locus, F.lit(NOVEL), content_hash(s, 6))
    marker = F.when(F.col("b.ident") >= min_identity, ref).when(F.col("b.ident") > 0, novel).otherwise(F.concat(F.lit(NOVEL_MARKER), content_hash(s, 6)))
    named = known.select("sequence", marker.alias("marker"), F.col("b.ident").alias("identity_pct"), F.col("b.cov").alias("coverage_pct"))
    return contigs.select("ord", "sequence").join(named, "sequence").select("ord", "marker", "identity_pct", "coverage_pct")


def filter_reads(reads: DataFrame, min_length: int = 300, max_length: int = 1500, min_quality: float = 10.0) -> DataFrame:
    """Reads ``(…, sequence, qual)`` of fitting length and mean quality."""
    return reads.filter(F.length("sequence").between(min_length, max_length) & (mean_phred(F.col("qual")) >= min_quality))


def read_support(reads: DataFrame, references: DataFrame, min_support: int = 5) -> DataFrame:
    """``(sample_id, marker, identity_pct, read_support, bitscore)``: reads that hold the first 20 letters of a haplotype.

    Reads are cut into their distinct 20-letter words and joined on the seed, so no read meets every reference.
    """
    seeds = references.filter(F.length("sequence") >= SEED).select("marker", F.substring("sequence", 1, SEED).alias("word"))
    words = reads.filter(F.length("sequence") >= SEED).select(
        "sample_id", "rec_no", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("sequence") - SEED + 1), lambda i: F.substring(F.col("sequence"), i, F.lit(SEED))))).alias("word")
    )
    support = words.join(seeds, "word").select("sample_id", "marker", "rec_no").distinct().groupBy("sample_id", "marker").agg(F.count("*").alias("read_support"))
    return support.filter(F.col("read_support") >= min_support).select("sample_id", "marker", F.lit(99.5).alias("identity_pct"), "read_support", (10 * F.col("read_support")).alias("bitscore"))


def consensus(reads: DataFrame, key: str, max_positions: int | None = None) -> DataFrame:
    """``(key, consensus, n_reads)``: the commonest letter at each place of the backbone.

    The backbone is the read whose length is nearest to the whole part of the median (first on ties, by ``rec_no``).
    Of equally common letters the first seen wins. ``max_positions`` ends the consensus earlier, if asked for.
    """
    text = F.col("sequence") if max_positions is None else F.substring("sequence", 1, max_positions)
    middle = reads.groupBy(key).agg(F.floor(F.median(F.length("sequence"))).alias("_m"), F.count("*").alias("n_reads"))
    backbone = reads.join(middle, key).groupBy(key, "n_reads").agg(F.min_by(F.length("sequence"), F.struct(F.abs(F.length("sequence") - F.col("_m")), "rec_no")).alias("_len"))
    letters = reads.select(key, "rec_no", F.posexplode(F.split(text, "")).alias("pos", "base")).filter("base <> ''")
    votes = letters.groupBy(key, "pos", "base").agg(F.count("*").alias("n"), F.min("rec_no").alias("_first"))
    best = votes.groupBy(key, "pos").agg(F.max_by("base", F.struct("n", -F.col("_first"))).alias("base"))
    return (
        best.join(backbone, key).filter(F.col("pos") < F.col("_len")).groupBy(key, "n_reads")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "base"))), lambda s: s["base"]), "").alias("consensus"))
        .select(key, "consensus", "n_reads")
    )


def longest_junctions(reads: DataFrame) -> DataFrame:
    """``(sample_id, sequence)``: the longest trimmed junction read over 20 letters, the first on ties."""
    own = reads.filter(is_junction_read(F.col("sequence"))).select("sample_id", "rec_no", trim_junction(F.col("sequence")).alias("s")).filter(F.length("s") > 20)
    return own.groupBy("sample_id").agg(F.max_by("s", F.struct(F.length("s"), -F.col("rec_no"))).alias("sequence"))


def junctions(reads: DataFrame) -> DataFrame:
    """``(sample_id, marker, sequence)``: each sample's junction: its longest trimmed junction read, trimmed and named."""
    own = longest_junctions(reads).withColumn("sequence", trim_junction(F.col("sequence"))).filter(F.length("sequence") > 0)
    return own.select("sample_id", junction_id(F.col("sample_id"), F.length("sequence")).alias("marker"), "sequence")
