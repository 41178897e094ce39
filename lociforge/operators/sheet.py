"""The specimen by marker sheet in long form: calls, completeness, marker dimension, frequencies and weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociforge.functions.identifiers import clean_id, locus_before_hap
from lociforge.functions.names import ploidy_of

MIN_FREQUENCY = 1e-4


def calls_view(calls: DataFrame) -> DataFrame:
    """Distinct ``(seq_id, locus, marker)`` with cleaned names; a null locus is read from the marker's name."""
    marker, locus = clean_id("marker"), clean_id("locus")
    own = calls.select(clean_id("seq_id").alias("seq_id"), F.coalesce(F.when(locus != "", locus), locus_before_hap(marker)).alias("locus"), marker.alias("marker"))
    return own.filter("seq_id <> '' and marker <> ''").distinct()


def marker_dimension(calls: DataFrame, ploidy=None) -> DataFrame:
    """``(locus, marker, ploidy)`` of all markers of the sheet; kept as an input, not derived from surviving calls."""
    return calls.select("locus", "marker").distinct().withColumn("ploidy", ploidy_of(F.col("locus"), ploidy).cast("int"))


def completeness(calls: DataFrame, specimens: DataFrame | None = None) -> DataFrame:
    """``(seq_id, n_loci, completeness)``: loci with a call over all loci of the sheet; 0 for specimens without calls."""
    loci = calls.select(F.countDistinct("locus").alias("total"))
    per = calls.groupBy("seq_id").agg(F.countDistinct("locus").alias("n_loci"))
    if specimens is not None:
        per = specimens.select("seq_id").distinct().join(per, "seq_id", "left").select("seq_id", F.coalesce("n_loci", F.lit(0).cast("long")).alias("n_loci"))
    return per.join(F.broadcast(loci)).select("seq_id", "n_loci", F.when(F.col("total") > 0, F.col("n_loci") / F.col("total")).otherwise(F.lit(1.0)).alias("completeness"))


def complete_calls(calls: DataFrame, min_completeness: float = 0.10) -> DataFrame:
    """The calls of specimens that are complete enough."""
    kept = completeness(calls).filter(F.col("completeness") >= min_completeness).select("seq_id")
    return calls.join(kept, "seq_id", "left_semi")


def allele_frequencies(calls: DataFrame, markers: DataFrame) -> DataFrame:
    """``(locus, marker, ploidy, carriers, called, p, w)``: masked frequency and its weight 1/sqrt(p(1-p))."""
    carriers = calls.groupBy("locus", "marker").agg(F.countDistinct("seq_id").alias("carriers"))
    called = calls.select("locus", "seq_id").distinct().groupBy("locus").agg(F.count("*").alias("called"))
    p = F.when(F.col("called").isNull(), F.lit(MIN_FREQUENCY)).otherwise(F.coalesce("carriers", F.lit(0)) / F.col("called"))
    clipped = F.least(F.greatest(p, F.lit(MIN_FREQUENCY)), F.lit(1 - MIN_FREQUENCY))
    return (
        markers.join(carriers, ["locus", "marker"], "left").join(called, "locus", "left")
        .select("locus", "marker", "ploidy", F.coalesce("carriers", F.lit(0).cast("long")).alias("carriers"), F.coalesce("called", F.lit(0).cast("long")).alias("called"), clipped.alias("p"))
        .withColumn("w", 1 / F.sqrt(F.col("p") * (1 - F.col("p"))))
    )


def allele_shares(calls: DataFrame) -> DataFrame:
    """``(locus, marker, n, share)``: carriers over all allele observations of the locus."""
    n = calls.groupBy("locus", "marker").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("locus")))


def entropies(calls: DataFrame) -> DataFrame:
    """``(locus, entropy)``: Shannon entropy of the allele shares, in bits."""
    return allele_shares(calls).groupBy("locus").agg((-F.sum(F.col("share") * F.log2("share"))).alias("entropy"))


def snp_locus_weights(calls: DataFrame, markers: DataFrame) -> DataFrame:
    """``(locus, w)``: mean over the locus's markers of 1/sqrt(max(p(1-p), 1e-6)), p over all specimens."""
    n = calls.select("seq_id").distinct().select(F.count("*").alias("_n"))
    carriers = calls.groupBy("locus", "marker").agg(F.countDistinct("seq_id").alias("carriers"))
    p = F.coalesce("carriers", F.lit(0)) / F.col("_n")
    return (
        markers.join(carriers, ["locus", "marker"], "left").join(F.broadcast(n))
        .groupBy("locus").agg(F.avg(1 / F.sqrt(F.greatest(p * (1 - p), F.lit(1e-6)))).alias("w"))
    )


def presence_sheet(calls: DataFrame, markers: list[str] | None = None, specimens: DataFrame | None = None) -> DataFrame:
    """The wide sheet: ``Seq_ID`` and a column for each marker, ``X`` or empty, both sorted. Only for the edge.

    ``specimens``: ``(seq_id)`` of those that have a row also without calls.
    """
    names = markers if markers is not None else [r[0] for r in calls.select("marker").distinct().orderBy("marker").limit(20_001).collect()]
    if len(names) > 20_000:
        raise ValueError("more than 20000 markers; keep the sheet in long form")
    wide = calls.groupBy(F.col("seq_id").alias("Seq_ID")).pivot("marker", names).agg(F.first(F.lit("X")))
    if specimens is not None:
        wide = specimens.select(F.col("seq_id").alias("Seq_ID")).union(calls.select("seq_id")).distinct().join(wide, "Seq_ID", "left")
    return wide.na.fill("").orderBy("Seq_ID")


def melt_sheet(sheet: DataFrame) -> DataFrame:
    """``(seq_id, marker)`` of the cells that hold ``X``."""
    key = next((c for c in sheet.columns if c.lower() == "seq_id"), sheet.columns[0])
    others = [c for c in sheet.columns if c != key]
    long = sheet.select(F.col(f"`{key}`").alias("seq_id"), *[F.col(f"`{c}`").cast("string").alias(c) for c in others]).unpivot("seq_id", [F.col(f"`{c}`") for c in others], "marker", "cell")
    return long.filter(F.col("cell") == "X").select("seq_id", "marker")
