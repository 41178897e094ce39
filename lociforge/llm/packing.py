"""Texts into containers of fixed capacity: optimal length buckets and token-budget batches.

1. Every text is measured in tokens. A text larger than the capacity alone is cut into full pieces and a rest.
2. The histogram of piece lengths over all texts has at most ``MAX_LENGTHS`` rows; in larger containers lengths are rounded up to
   that many steps. Dynamic programming chooses the bucket boundaries that minimise the padding, that is the sum of boundary
   less length.
3. Token-budget batches form inside each bucket: a container takes as many of its pieces as its budget holds. Batches of the
   longest pieces are then topped up: what room they leave takes pieces of shorter buckets, which form the fewer batches of
   their own. Both steps work on the bucket counts, and the same filling is used as often as they allow: a table of a few
   hundred rows, whatever the corpus.
4. Each piece gets its place in its bucket by counts over hashed parts and a rank inside each part, and finds its
   container in the table. No bucket passes through one task.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lociforge.llm.text import slices
from lociforge.session import Cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the tokenizer splits a text before merging; fixed value of its public definition.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BUCKETS = 128
PART_ROWS = 500_000
MAX_LENGTHS = 1 << 17
MAX_CONTAINER_KINDS = 100


@lru_cache(maxsize=2)
def _encoding(ranks: bytes):
    import tiktoken

    pairs = (line.split() for line in ranks.splitlines() if line)
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})


def vocabulary(spark: SparkSession, tokenizer: str) -> bytes:
    """A vocabulary file, from the driver's disk or, with a scheme, from any file system that Spark reads."""
    if "://" in tokenizer:
        return bytes(spark.read.format("binaryFile").load(tokenizer).select("content").first()[0])
    with open(tokenizer, "rb") as f:
        return f.read()


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``(doc_id, n_tokens)`` of each row; a null text has none. The vocabulary file goes to the tasks as a broadcast."""
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary(documents.sparkSession, tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(shared.value).encode_to_numpy
        for batch in slices(batches, "text", 4_000_000):
            n = np.fromiter((len(encode(t, disallowed_special=())) if t else 0 for t in batch.column("text").to_pylist()), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n)], names=["doc_id", "n_tokens"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long")


def optimal_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> np.ndarray:
    """Upper bounds of at most ``buckets`` buckets with the least padding; ``lengths`` ascending.

    One row of the table per number of buckets; as the best split moves up with the end, each row is filled by halving
    the ends, all ends of a level in one array operation.
    """
    n = len(lengths)
    if n <= buckets:
        return lengths.copy()
    items = np.r_[0, np.cumsum(counts)].astype(np.float64)
    total = np.r_[0, np.cumsum(counts * lengths)].astype(np.float64)
    bound = np.r_[0, lengths].astype(np.float64)
    best = np.full(n + 1, np.inf)
    best[0] = 0
    splits = np.zeros((buckets, n + 1), np.int32)
    for k in range(buckets):
        now, split = np.full(n + 1, np.inf), np.zeros(n + 1, np.int32)
        spans = np.array([[1, n, 0, n - 1]])  # ends lo..hi, splits from..to
        while len(spans):
            lo, hi, first, last = spans.T
            mid = (lo + hi) // 2
            last_here = np.minimum(last, mid - 1)
            first_here = np.minimum(first, last_here)
            size = last_here - first_here + 1
            start = np.r_[0, np.cumsum(size)[:-1]]
            s = np.repeat(first_here - start, size) + np.arange(size.sum())
            e = np.repeat(mid, size)
            cost = best[s] + bound[e] * (items[e] - items[s]) - (total[e] - total[s])
            low = np.minimum.reduceat(cost, start)
            at = np.where(cost == np.repeat(low, size), s, n + 1)
            pick = np.minimum.reduceat(at, start)
            pick = np.where(np.isfinite(low), pick, first_here)
            now[mid], split[mid] = low, pick
            spans = np.concatenate([np.stack([lo, mid - 1, first, pick], 1)[lo < mid], np.stack([mid + 1, hi, pick, last], 1)[mid < hi]])
        splits[k] = split
        best = now
    out, e = [], n
    for k in range(buckets - 1, -1, -1):
        out.append(lengths[e - 1])
        e = splits[k][e]
        if e == 0:
            break
    return np.array(out[::-1])


def fillings(bounds: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[int, dict[int, int]]]:
    """``(times, {bucket: pieces})``: how containers are filled, and how many so.

    The batches of the longest pieces come first; each is topped up with the longest pieces of other buckets that fit.
    """
    left = counts.astype(np.int64).copy()
    per = capacity // bounds
    out = []
    for own in range(len(bounds) - 1, -1, -1):
        while left[own]:
            batch = int(min(per[own], left[own]))  # inside the bucket
            filling, room = {own: batch}, capacity - batch * int(bounds[own])
            for b in np.flatnonzero(left[:own])[::-1]:
                n = min(room // int(bounds[b]), int(left[b]))
                if n:
                    filling[int(b)] = n
                    room -= n * int(bounds[b])
            times = min(int(left[b]) // n for b, n in filling.items())
            for b, n in filling.items():
                left[b] -= times * n
            out.append((times, filling))
    return out


def pack(documents: DataFrame, containers: DataFrame, tokenizer: str = TOKENIZER, buckets: int = BUCKETS, cut: Cut | None = None, max_lengths: int = MAX_LENGTHS) -> DataFrame:
    """``(container_kind, container_no, doc_id, piece_no, token_from, tokens, bucket)``: each text's pieces for each kind.

    ``documents``: ``(doc_id, text)``; ``containers``: ``(container_kind, capacity_tokens)``; further columns are
    ignored. A text is cut only if it alone is larger than the capacity, and no container holds more than that. Texts
    without tokens (null, empty) take no room: their one row has no ``container_no`` and no ``bucket``. Rows with equal ``doc_id`` are
    items of their own. Kinds without a positive capacity are left out. Empty tables give no rows.
    """
    spark = documents.sparkSession
    cut = cut or Cut(spark)
    kinds = [tuple(r) for r in containers.select("container_kind", F.col("capacity_tokens").cast("int")).filter("capacity_tokens > 0").distinct().orderBy("container_kind", "capacity_tokens").limit(MAX_CONTAINER_KINDS + 1).collect()]
    if len(kinds) > MAX_CONTAINER_KINDS:
        raise ValueError(f"more than {MAX_CONTAINER_KINDS} kinds of container")
    sizes = cut.write(token_counts(documents, tokenizer))
    kind_table = spark.createDataFrame([(i, k, c) for i, (k, c) in enumerate(kinds)], "kind int, container_kind string, capacity int")
    n, c = F.col("n_tokens"), F.col("capacity")
    pieces = (
        sizes.join(F.broadcast(kind_table.select("kind", "capacity")))
        .withColumn("piece_no", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(n / c) - 1, F.lit(0)).cast("int"))))
        .select("kind", "doc_id", "piece_no", (F.col("piece_no") * c).cast("long").alias("token_from"), F.least(c.cast("long"), n - F.col("piece_no") * c).cast("int").alias("tokens"))
    )
    steps = {i: -(-capacity // max_lengths) for i, (_, capacity) in enumerate(kinds)}
    unit = F.lit(1)
    for i, u in steps.items():
        unit = F.when(F.col("kind") == i, F.lit(u)).otherwise(unit) if u > 1 else unit
    pieces = pieces.withColumn("length", (F.ceil(F.col("tokens") / unit) * unit).cast("int"))
    histogram = pieces.filter("tokens > 0").groupBy("kind", "length").count().collect()  # at most MAX_LENGTHS rows a kind
    bucket_rows, slot_rows = [], []
    for i, (_, capacity) in enumerate(kinds):
        own = sorted((min(r["length"], capacity), r["length"], r["count"]) for r in histogram if r["kind"] == i)
        if not own:
            continue
        # a piece as long as the container is not rounded up beyond it
        lengths, counts = np.array([x for x, _, _ in own], np.int64), np.array([x for _, _, x in own], np.int64)
        bounds = optimal_boundaries(lengths, counts, buckets)
        bucket_of = np.searchsorted(bounds, lengths)
        held = np.bincount(bucket_of, weights=counts, minlength=len(bounds)).astype(np.int64)
        parts = np.maximum(1, -(-held // PART_ROWS))
        bucket_rows += [(i, int(x), int(b), int(parts[b])) for (_, x, _), b in zip(own, bucket_of)]
        used, base = np.zeros(len(bounds), np.int64), 1
        for times, filling in fillings(bounds, held, capacity):
            for b, m in filling.items():
                slot_rows.append((i, b, int(used[b]), int(used[b]) + times * m, m, base))
                used[b] += times * m
            base += times
    bucket_table = spark.createDataFrame(bucket_rows, "kind int, length int, bucket int, parts int")
    slots = spark.createDataFrame(slot_rows, "kind int, bucket int, first long, past long, per long, base long")
    placed = (
        pieces.join(F.broadcast(bucket_table), ["kind", "length"])
        .withColumn("part", F.pmod(F.xxhash64("doc_id", "piece_no"), F.col("parts")).cast("int"))
        .withColumn("_rank", F.row_number().over(Window.partitionBy("kind", "bucket", "part").orderBy("doc_id", "piece_no")))
    )
    placed = cut.write(placed.select("kind", "doc_id", "piece_no", "token_from", "tokens", "bucket", "part", "_rank"))
    before = Window.partitionBy("kind", "bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("kind", "bucket", "part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    at = placed.join(F.broadcast(offsets), ["kind", "bucket", "part"]).withColumn("_at", F.col("_before") + F.col("_rank") - 1)
    slot = F.broadcast(slots.withColumnRenamed("kind", "_k").withColumnRenamed("bucket", "_b"))
    boxed = at.join(slot, (F.col("kind") == F.col("_k")) & (F.col("bucket") == F.col("_b")) & (F.col("_at") >= F.col("first")) & (F.col("_at") < F.col("past")))
    boxed = boxed.select("kind", (F.col("base") + F.floor((F.col("_at") - F.col("first")) / F.col("per"))).cast("long").alias("container_no"), "doc_id", "piece_no", "token_from", "tokens", "bucket")
    empty = pieces.filter("tokens = 0").select("kind", F.lit(None).cast("long").alias("container_no"), "doc_id", "piece_no", "token_from", "tokens", F.lit(None).cast("int").alias("bucket"))
    return boxed.unionByName(empty).join(F.broadcast(kind_table.select("kind", "container_kind")), "kind").select("container_kind", "container_no", "doc_id", "piece_no", "token_from", "tokens", "bucket")


def fill_report(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """``(container_kind, n_containers, n_pieces, n_tokens, fullest, fill, n_batches, batch_fill)``: how full the containers are.

    ``n_batches`` and ``batch_fill`` are those of batches that stay inside their buckets, before they are topped up.
    """
    size = F.broadcast(containers.select("container_kind", F.col("capacity_tokens").cast("int").alias("c")).filter("c > 0").distinct())
    held = packed.filter("container_no is not null")
    own = held.groupBy("container_kind", "container_no").agg(F.count("*").alias("_p"), F.sum("tokens").alias("_t"))
    sums = own.groupBy("container_kind").agg(F.count("*").alias("n_containers"), F.sum("_p").alias("n_pieces"), F.sum("_t").alias("n_tokens"), F.max("_t").alias("fullest"))
    buckets = held.groupBy("container_kind", "bucket").agg(F.count("*").alias("_n"), F.max("tokens").alias("_bound")).join(size, "container_kind")
    batches = buckets.groupBy("container_kind").agg(F.sum(F.ceil(F.col("_n") / F.floor(F.col("c") / F.col("_bound")))).alias("n_batches"))
    share = lambda n: F.round(F.col("n_tokens") / (F.col(n) * F.col("c")), 6)
    return sums.join(batches, "container_kind").join(size, "container_kind").select(
        "container_kind", "n_containers", "n_pieces", "n_tokens", "fullest", share("n_containers").alias("fill"), "n_batches", share("n_batches").alias("batch_fill")
    )


def faults(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """``(container_kind, n_texts, n_overfull, n_cut, n_differing)``: texts packed, and what must be 0.

    Containers over their capacity, pieces of a text that fits whole, and texts whose pieces have another sum than in other kinds.
    """
    size = containers.select("container_kind", F.col("capacity_tokens").cast("int").alias("c")).filter("c > 0").distinct()
    over = packed.filter("container_no is not null").groupBy("container_kind", "container_no").agg(F.sum("tokens").alias("t")).join(F.broadcast(size), "container_kind")
    over = over.groupBy("container_kind").agg(F.sum((F.col("t") > F.col("c")).cast("long")).alias("n_overfull"))
    texts = packed.groupBy("container_kind", "doc_id").agg(F.sum("tokens").alias("t"), F.sum((F.col("piece_no") == 0).cast("long")).alias("n"), F.count("*").alias("p")).join(F.broadcast(size), "container_kind")
    sums = texts.groupBy("doc_id").agg((F.min("t") != F.max("t")).alias("d"))
    texts = texts.join(sums, "doc_id").groupBy("container_kind").agg(
        F.sum("n").alias("n_texts"), F.sum(((F.col("t") <= F.col("c")) & (F.col("p") > F.col("n"))).cast("long")).alias("n_cut"), F.sum(F.col("d").cast("long")).alias("n_differing")
    )
    return texts.join(over, "container_kind").select("container_kind", "n_texts", "n_overfull", "n_cut", "n_differing")
