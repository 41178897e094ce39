"""References to records that do not exist: Bloom filter first, exact join only for what it lets through.

The filter is blocked: all bits of a key lie in one 64-bit word, so that it is a table ``(word, bits)`` built by a
partial aggregate and probed by a join on the word's number. It has ``BITS_PER_KEY`` bits for each parent key, so what it
proves doesn't change with their number. It is broadcast up to ``MAX_BROADCAST`` words (8 bytes each); a larger one is
spread over the cluster by word, and each part meets its own references.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociforge.functions.identifiers import clean_id

BITS_PER_KEY = 16
PROBES = 5
MAX_BROADCAST = 1 << 20


def _word(key: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(words)).cast("long")


def _mask(key: str) -> Column:
    """The key's ``PROBES`` bits in its word, from slices of a second hash."""
    bits = [F.expr(f"shiftleft(1L, cast(shiftrightunsigned(xxhash64({key}, 1), {6 * k}) & 63 as int))") for k in range(PROBES)]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask.bitwiseOR(b)
    return mask


def bloom_filter(parents: DataFrame, key: str) -> tuple[DataFrame, int]:
    """``(word, bits)`` over the distinct parent keys, and the number of words, in proportion to them."""
    keys = parents.select(F.col(key).alias("_k")).filter("_k is not null")
    n = max(1, parents.select(F.approx_count_distinct(key)).first()[0])
    words = 1 << max(4, math.ceil(math.log2(n * BITS_PER_KEY / 64)))
    table = keys.select(_word(F.col("_k"), words).alias("word"), _mask("_k").alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    return table, words


def references(spark_table: DataFrame, name: str, row: str, ids: list[str], at: str) -> DataFrame:
    """``(ref_table, row_no, seq_id, at)``: one row for each distinct id of a reference row; null and blank ids don't count."""
    cleaned = F.array(*[clean_id(F.col(c)) for c in ids])
    return (
        spark_table.select(F.lit(name).alias("ref_table"), F.col(row).alias("row_no"), F.explode(F.array_distinct(cleaned)).alias("seq_id"), F.col(at).cast("timestamp_ntz").alias("at"))
        .filter("seq_id is not null and seq_id <> ''")
    )


def orphans(refs: DataFrame, parents: DataFrame, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """The rows of ``refs`` ``(ref_table, row_no, seq_id, at)`` whose id no parent row holds at that time.

    ``parents``: ``(seq_id, received_at, removed_at)``; a row holds its id from ``received_at`` until before
    ``removed_at`` (null: for ever; a null ``received_at`` never holds at a known time). Without a time a reference
    dangles only if no parent row has its id at all. Extra columns of either table are ignored. Adds ``definite``: the
    filter alone proved that the id was never known. Repeated references give one row; with no parents all dangle.
    """
    refs = refs.select("ref_table", "row_no", "seq_id", "at")
    held = parents.select(clean_id("seq_id").alias("seq_id"), F.col("received_at").cast("timestamp_ntz").alias("_from"), F.col("removed_at").cast("timestamp_ntz").alias("_to")).filter("seq_id is not null")
    filter_table, words = bloom_filter(held, "seq_id")
    near = F.broadcast(filter_table) if words <= max_broadcast else filter_table
    probed = (
        refs.withColumn("_mask", _mask("seq_id"))
        .withColumn("word", _word(F.col("seq_id"), words))
        .join(near, "word", "left")
        .withColumn("_maybe", F.coalesce(F.col("bits").bitwiseAND(F.col("_mask")) == F.col("_mask"), F.lit(False)))
        .select("ref_table", "row_no", "seq_id", "at", "_maybe")
    )
    definite = probed.filter(~F.col("_maybe")).select("ref_table", "row_no", "seq_id", "at", F.lit(True).alias("definite"))
    # only references of perhaps known ids are shuffled; AQE splits a hot id's references, and the span set is distinct
    spans = held.distinct().withColumnRenamed("seq_id", "_id")
    holds = (F.col("seq_id") == F.col("_id")) & (
        F.col("at").isNull() | ((F.col("_from") <= F.col("at")) & (F.col("_to").isNull() | (F.col("_to") > F.col("at"))))
    )
    verified = probed.filter("_maybe").join(spans, holds, "left_anti").select("ref_table", "row_no", "seq_id", "at", F.lit(False).alias("definite"))
    return definite.unionByName(verified).distinct()


def period_of(at: Column) -> Column:
    return F.coalesce(F.date_format(at, "yyyy-MM"), F.lit("unknown"))


def orphan_report(found: DataFrame) -> DataFrame:
    """Dangling references per table and period: rows, distinct ids and how many the filter alone proved."""
    return found.groupBy("ref_table", period_of(F.col("at")).alias("period")).agg(
        F.count("*").alias("n_orphans"), F.countDistinct("seq_id").alias("n_ids"), F.sum(F.col("definite").cast("long")).alias("n_never_known")
    )
