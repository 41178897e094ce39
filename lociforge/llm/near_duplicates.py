"""Near-duplicate sequences by fast similarity sketching, banding and exact verification.

A record is its set of distinct k-letter substrings. The sketch has ``bands * rows`` coordinates. In round i every
element draws a bin and a value; a bin that is still empty takes the smallest value that falls on it. The first t
rounds draw the bin by hash, in the last t rounds round t + j fills bin j, so that every coordinate is filled after at
most 2t rounds. Two sketches agree at a coordinate with the Jaccard similarity J of the sets as its probability, with
concentration as for independent draws, so a pair meets in some band with 1 - (1 - J^rows)^bands: with 64 bands of 4
rows, 0.99986 at J = 0.6. Pairs that meet are verified exactly on the whole sets, which are built once for each record.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociforge.llm.linking import linked_components
from lociforge.llm.text import slices
from lociforge.session import Cut

K = 8
MIN_LETTERS = 20
THRESHOLD = 0.6
BANDS = 64
ROWS = 4
EMPTY = np.uint32(0xFFFFFFFF)
SLICE = 300_000
PAIR_BYTES = 1_000_000


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: multiply and shift, wrapping."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def rolling_codes(digits: np.ndarray, k: int) -> np.ndarray:
    """The code of the ``k`` letters that begin at each place; the last ``k - 1`` places have none that is whole."""
    code = np.zeros(len(digits), np.uint32)
    padded = np.r_[digits, np.zeros(k - 1, digits.dtype)].astype(np.uint32)
    for i in range(k):
        code = code * np.uint32(4) + padded[i : len(digits) + i]
    return code


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all ranges of so many from each start, one after the other."""
    before = np.cumsum(size) - size
    return np.repeat(start - before, size) + np.arange(size.sum())


def distinct_substrings(texts: list[bytes], k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the distinct k-letter substrings of A/C/G/T texts, the text of each and its first place in all letters.

    Sorted by text and code.
    """
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    letters = np.frombuffer(b"".join(texts), np.uint8)
    code = rolling_codes((letters >> 1) & 3, k).astype(np.int64)  # A, C, T, G give 0, 1, 2, 3
    whole = np.maximum(lengths - k + 1, 0)
    at = _ranges(np.cumsum(lengths) - lengths, whole)
    if not len(at):
        return np.empty(0, np.int64), np.empty(0, np.int64), at
    bits = int(at[-1]).bit_length()
    # one sort of whole numbers: text, code, place; a text of a slice is told by its place, so its number needs few bits
    key = (((np.repeat(np.arange(len(texts)), whole) << (2 * k)) | code[at]) << bits) | at
    key.sort()
    both = key >> bits
    first = np.r_[True, both[1:] != both[:-1]]
    both = both[first]
    return both & ((1 << (2 * k)) - 1), both >> (2 * k), key[first] & ((1 << bits) - 1)


@lru_cache(maxsize=4096)
def _draw(i: int, t: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and value of every possible element in round i."""
    h = mix64(np.arange(1 << (2 * k), dtype=np.uint64) + np.uint64((i + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
    bins = (h >> np.uint64(40)) % np.uint64(t) if i < t else np.full(len(h), i - t, np.uint64)
    return bins.astype(np.int32), (h & np.uint64(0x7FFFFFFF)).astype(np.uint32)


def sketch(code: np.ndarray, owner: np.ndarray, n: int, t: int, k: int = K) -> np.ndarray:
    """``(n, t)`` sketch coordinates; rows of owners without elements stay ``EMPTY``."""
    out = np.full((n, t), EMPTY, np.uint32)
    ids, start = np.arange(n), owner
    for i in range(2 * t):
        if not len(code):
            break
        bins, values = _draw(i, t, k)
        fresh = np.full(len(ids) * t, EMPTY, np.uint32)
        np.minimum.at(fresh, start * t + bins[code], values[code])
        fresh = fresh.reshape(len(ids), t)
        rows = out[ids]
        rows = np.where((rows == EMPTY) & (fresh != EMPTY), fresh, rows)
        out[ids] = rows
        missing = (rows == EMPTY).any(1)
        missing &= np.bincount(start, minlength=len(ids)) > 0
        keep = missing[start]
        code, start = code[keep], (np.cumsum(missing) - 1)[start[keep]]
        ids = ids[missing]
    return out


def band_keys(sketches: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """``(n, bands)`` 64-bit keys of the bands."""
    parts = sketches.reshape(len(sketches), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), parts.shape[:2])
    for r in range(rows):
        key = mix64(key + parts[:, :, r].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return key.view(np.int64)


def _binaries(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """One binary value of so many bytes for each record."""
    offsets = np.r_[0, np.cumsum(sizes)].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _bytes_of(column: pa.Array) -> np.ndarray:
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(column) and column.buffers()[2] else np.empty(0, np.uint8)


def sketched(records: DataFrame, bands: int = BANDS, rows: int = ROWS, k: int = K) -> DataFrame:
    """``(node, keys, n, letters, firsts)`` of each ``(node, seq)``: band keys, number of substrings, and the set itself.

    The set is kept as its text in two bits a letter and one bit for each place where a substring comes first, both padded to whole
    bytes: a third of a byte a letter, from which its codes come back without sorting.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "seq", SLICE):
            texts = [s.encode() for s in batch.column("seq").to_pylist()]
            code, owner, first = distinct_substrings(texts, k)
            keys = band_keys(sketch(code, owner, len(texts), bands * rows, k), bands, rows)
            lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
            room = -(-lengths // 8) * 8
            shift = (np.cumsum(room) - room) - (np.cumsum(lengths) - lengths)
            digits, marks = np.zeros(room.sum(), np.uint8), np.zeros(room.sum(), bool)
            digits[np.arange(lengths.sum()) + np.repeat(shift, lengths)] = (np.frombuffer(b"".join(texts), np.uint8) >> 1) & 3
            marks[first + shift[owner]] = True
            four = digits.reshape(-1, 4)
            packed = (four[:, 0] << 6) | (four[:, 1] << 4) | (four[:, 2] << 2) | four[:, 3]
            offsets = np.arange(len(texts) + 1, dtype=np.int32) * bands
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.ListArray.from_arrays(offsets, pa.array(keys.ravel())), pa.array(np.bincount(owner, minlength=len(texts)).astype(np.int32)), _binaries(packed, room // 4), _binaries(np.packbits(marks), room // 8)],
                names=["node", "keys", "n", "letters", "firsts"],
            )

    return records.select("node", "seq").mapInArrow(run, "node long, keys array<long>, n int, letters binary, firsts binary")


#: The four letters of each byte.
_LETTERS = ((np.arange(256)[:, None] >> np.array([6, 4, 2, 0])) & 3).astype(np.uint8)


def _codes(letters: pa.Array, firsts: pa.Array, k: int) -> np.ndarray:
    """The distinct codes of records, one record after the other."""
    return rolling_codes(_LETTERS[_bytes_of(letters)].ravel(), k)[np.flatnonzero(np.unpackbits(_bytes_of(firsts)))]


def verified(pairs: DataFrame, records: DataFrame, threshold: float = THRESHOLD, k: int = K) -> DataFrame:
    """The pairs ``(a, b)`` of ``sketched`` records whose sets have at least this exact Jaccard similarity, as ``(a, b, sim)``.

    Pairs whose sets' sizes rule it out are left out first. A task marks each ``a``'s codes in a table once and counts
    those of its partners that are marked.
    """
    per_mille = round(threshold * 1000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << (2 * k), bool)
        for whole in batches:
            for batch in slices(iter([whole]), ("la", "lb"), PAIR_BYTES):
                a = batch.column("a").to_numpy()
                if (a[1:] < a[:-1]).any():
                    batch = batch.take(pa.array(np.argsort(a, kind="stable")))
                    a = batch.column("a").to_numpy()
                na, nb = batch.column("na").to_numpy().astype(np.int64), batch.column("nb").to_numpy().astype(np.int64)
                first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
                left = batch.select(["la", "fa"]).take(pa.array(first))
                codes_a, end_a = _codes(left.column(0), left.column(1), k), np.cumsum(na[first])
                codes_b, end_b = _codes(batch.column("lb"), batch.column("fb"), k), np.cumsum(nb)
                held = np.empty(len(codes_b), bool)
                lo_a = lo_b = 0
                for hi_a, hi_b in zip(end_a, end_b[np.r_[first[1:], len(a)] - 1]):
                    own = codes_a[lo_a:hi_a]
                    table[own] = True
                    held[lo_b:hi_b] = table[codes_b[lo_b:hi_b]]
                    table[own] = False
                    lo_a, lo_b = hi_a, hi_b
                shared = np.add.reduceat(held, end_b - nb, dtype=np.int64)
                union = na + nb - shared
                # in whole numbers, so that a similarity of exactly the threshold counts
                good = shared * 1000 >= per_mille * union
                yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(batch.column("b").to_numpy()[good]), pa.array((shared / union)[good])], names=["a", "b", "sim"])

    sized = pairs.join(records.select(F.col("node").alias("b"), F.col("n").alias("nb")), "b").join(records.select(F.col("node").alias("a"), F.col("n").alias("na")), "a")
    sized = sized.filter(F.least("na", "nb") * 1000 >= per_mille * F.greatest("na", "nb"))
    joined = (
        sized.join(records.select(F.col("node").alias("b"), F.col("letters").alias("lb"), F.col("firsts").alias("fb")), "b")
        .join(records.select(F.col("node").alias("a"), F.col("letters").alias("la"), F.col("firsts").alias("fa")), "a")
    )
    return joined.select("a", "b", "na", "nb", "la", "fa", "lb", "fb").mapInArrow(run, "a long, b long, sim double")


def clean_sequence(col: str) -> F.Column:
    return F.regexp_replace(F.upper(F.col(col)), "[^ACGT]", "")


def near_duplicate_groups(records: DataFrame, cut: Cut | None = None, threshold: float = THRESHOLD, k: int = K, bands: int = BANDS, rows: int = ROWS, min_letters: int = MIN_LETTERS) -> DataFrame:
    """``(rec_no, group_no)``: every counted record, with the smallest number of its group.

    ``records``: ``(rec_no long, sequence string)``; further columns are ignored. Sequences are read upper-case with
    everything but A, C, G, T removed; null, empty and shorter ones than ``min_letters`` have no row. A group is
    everything connected through pairs of Jaccard similarity ``threshold`` or more. Equal sequences are one record in
    the comparison; a record like no other is its own group. A repeated ``rec_no`` is one record if its sequence is
    equal, else its sequences' groups are each reported. An empty table gives no rows.
    """
    cut = cut or Cut(records.sparkSession)
    own = records.select(F.col("rec_no").cast("long").alias("rec_no"), clean_sequence("sequence").alias("seq")).filter((F.length("seq") >= max(min_letters, k)) & F.col("rec_no").isNotNull())
    own = own.select("rec_no", "seq", F.md5("seq").alias("_h"))
    distinct = cut.write(own.groupBy("_h").agg(F.min("rec_no").alias("node"), F.first("seq").alias("seq")))
    records = cut.write(sketched(distinct, bands, rows, k))  # each record is sketched once
    buckets = records.select(F.explode("keys").alias("key"), "node")
    groups, _ = linked_components(buckets, lambda p: verified(p, records, threshold, k), cut)
    members = own.select("rec_no", "_h").distinct().join(distinct.select("_h", "node"), "_h").join(groups, "node", "left")
    return members.select("rec_no", F.coalesce("comp", "node").alias("group_no")).distinct()


def group_pairs(groups: DataFrame) -> DataFrame:
    """``(first_no, rec_no)``: each group's smallest number with each other one."""
    return groups.filter("rec_no <> group_no").select(F.col("group_no").alias("first_no"), "rec_no")
