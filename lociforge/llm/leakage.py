"""Passages of held-out items in a corpus, by SimHash windows, multi-index Hamming blocks and exact verification.

A match is a run of ``MIN_WORDS`` successive words of a passage with at most ``MAX_EDITS`` of them changed, dropped or
added. Windows of two sizes propose candidates. Windows of a whole run have the SimHash of their weighted two-word
shingles, common ones weighing less. Fingerprints of runs with two edits can lie up to 16 of 64 bits apart, which no block
index separates from chance, so these find the runs with fewer or lighter edits. Cut into MAX_EDITS + 1 parts, a run has a part
without any edit; windows of that size, with the SimHash of their words, find every run, at distance 0. The blocks of a
fingerprint radius r find all windows of either kind at distance r or less: such fingerprints agree in one of r + 1 blocks.

Candidates are verified by weighted-shingle similarity: the shingles that item and text share around the place must weigh
what any run through it keeps after its edits. An alignment of the words to both sides decides about the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociforge.llm.text import slices, word_hashes, words
from lociforge.operators.ordering import running
from lociforge.session import Cut

MIN_WORDS = 27
MAX_EDITS = 2
RADIUS = 2
MAX_WORDS_AT_ONCE = 2_000_000
SLICE = 1_000_000
HEAVIEST = 3
END_OF_TEXT, END_OF_ITEM = np.uint64(0), np.uint64(1)  # marks that no word's hash is taken for


def signs(hashes: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of each hash."""
    return (np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.int8) << 1) - 1


def shingles(h: np.ndarray) -> np.ndarray:
    """A code for each two successive words."""
    x = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _window_sums(x: np.ndarray, window: int) -> np.ndarray:
    """The sums of each so many successive rows, from sums of doubled length."""
    doubled, size = {1: x}, 1
    while 2 * size <= window:
        y = doubled[size]
        doubled[2 * size] = y[:-size] + y[size:]
        size *= 2
    n, total, at = len(x) - window + 1, None, 0
    for size in sorted(doubled, reverse=True):
        if window & size:
            part = doubled[size][at : at + n]
            total = part.copy() if total is None else np.add(total, part, out=total)
            at += size
    return total


def fingerprints(codes: np.ndarray, word_signs: np.ndarray, window: int) -> np.ndarray:
    """SimHash of each window of so many successive words: the sign of the sum of its words' bits."""
    if len(codes) < window:
        return np.empty(0, np.uint64)
    return np.packbits(_window_sums(word_signs[codes], window) > 0, axis=1).view("<u8").ravel()


def weighted_fingerprints(shingle: np.ndarray, weight: np.ndarray, window: int) -> np.ndarray:
    """SimHash of each window of so many successive shingles, each bit counted by the shingle's weight."""
    if len(shingle) < window:
        return np.empty(0, np.uint64)
    kind = np.int8 if window * HEAVIEST < 128 else np.int32
    return np.packbits(_window_sums(signs(shingle).astype(kind) * weight.astype(kind)[:, None], window) > 0, axis=1).view("<u8").ravel()


class Windows:
    """Fingerprints of windows, indexed by block."""

    def __init__(self, fp: np.ndarray, at: np.ndarray, radius: int):
        self.at, self.fp, self.radius = at, fp[at], radius
        edges = [round(64 * b / (radius + 1)) for b in range(radius + 2)]
        self.blocks = []
        for lo, hi in zip(edges, edges[1:]):
            value = (self.fp >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1)
            order = np.argsort(value, kind="stable")
            short = np.zeros(1 << min(hi - lo, 22), bool)
            short[(value & np.uint64(len(short) - 1)).astype(np.int64)] = True
            self.blocks.append((lo, hi, value[order], order, short))

    def candidates(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in ``fp``, places in the passages' words and distances of all pairs within the radius."""
        where, which = [], []
        for lo, hi, value, order, short in self.blocks:
            mine = (fp >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1)
            at = np.flatnonzero(short[(mine & np.uint64(len(short) - 1)).astype(np.int64)])
            lo_at, hi_at = np.searchsorted(value, mine[at], "left"), np.searchsorted(value, mine[at], "right")
            n = hi_at - lo_at
            where.append(np.repeat(at, n))
            which.append(order[np.repeat(lo_at - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())])
        where, which = np.concatenate(where), np.concatenate(which)
        near = np.bitwise_count(fp[where] ^ self.fp[which]) <= self.radius
        both = np.unique((where[near] << 32) | which[near])
        where, which = both >> 32, both & 0xFFFFFFFF
        return where, self.at[which], np.bitwise_count(fp[where] ^ self.fp[which])


class Passages:
    """The words, shingles and windows of a bounded set of passages, given as word hashes."""

    def __init__(self, ids: list[int], texts: list[np.ndarray], min_words: int, max_edits: int, radius: int):
        self.ids, self.run, self.part = np.array(ids, np.int64), min_words, min_words // (max_edits + 1)
        lengths = np.array([len(t) for t in texts], np.int64)
        self.words = np.concatenate([np.r_[t, END_OF_ITEM] for t in texts]) if texts else np.empty(0, np.uint64)
        self.owner = np.repeat(np.arange(len(texts)), lengths + 1)
        left = np.concatenate([np.arange(n, -1, -1) for n in lengths]) if texts else np.empty(0, np.int64)  # words up to the end
        inside = lambda fp, n: np.flatnonzero(left[: len(fp)] >= n)
        self.shingle = shingles(self.words) if len(self.words) else np.empty(0, np.uint64)
        once = np.unique(np.stack([self.owner[:-1].astype(np.uint64), self.shingle]), axis=1)[1] if len(self.shingle) else self.shingle
        self.known, n_items = np.unique(once, return_counts=True)
        self.df = n_items
        distinct, codes = np.unique(self.words, return_inverse=True)
        fp = fingerprints(codes, signs(distinct), self.part)
        self.parts = Windows(fp, inside(fp, self.part), radius)
        fp = weighted_fingerprints(self.shingle, self.weights(self.shingle), self.run - 1)
        self.wholes = Windows(fp, inside(fp, self.run), radius)
        # what the lightest run through each place keeps when its edits take the heaviest shingles
        self.share = self.rarity(self.shingle)
        size = self.run - 1
        kept = np.full(len(self.words), np.inf)
        if len(self.share) >= size:
            rows = np.sort(np.lib.stride_tricks.sliding_window_view(self.share, size), axis=1)
            keep = rows[:, : size - 2 * max_edits].sum(1)
            kept[: len(keep)] = np.where(left[: len(keep)] >= self.run, keep, np.inf)
        back = np.r_[np.full(self.run, np.inf), kept]
        self.need = np.lib.stride_tricks.sliding_window_view(back, self.run + 1).min(1) if len(self.words) else kept

    def rarity(self, shingle: np.ndarray) -> np.ndarray:
        """One over the number of items that hold each shingle; 1 for others."""
        if not len(self.known):
            return np.ones(len(shingle))
        at = np.minimum(np.searchsorted(self.known, shingle), len(self.known) - 1)
        return np.where(self.known[at] == shingle, 1 / self.df[at], 1.0)

    def weights(self, shingle: np.ndarray) -> np.ndarray:
        """Whole-number weights up to ``HEAVIEST``: shingles of several items weigh less."""
        return np.maximum(np.round(self.rarity(shingle) * HEAVIEST), 1).astype(np.int8)

    def similar(self, shingle: np.ndarray, at: np.ndarray, place: np.ndarray, slack: int) -> np.ndarray:
        """Whether the shingles shared around ``(place, at)`` weigh enough for some run through it."""
        good = np.zeros(len(at), bool)
        mine, theirs = np.arange(-self.run, self.run - 1), np.arange(-self.run - slack, self.run - 1 + slack)
        for lo in range(0, len(at), 2000):
            p, t = place[lo : lo + 2000, None] + mine, at[lo : lo + 2000, None] + theirs
            ok_p, ok_t = (p >= 0) & (p < len(self.shingle)), (t >= 0) & (t < len(shingle))
            p, t = np.clip(p, 0, len(self.shingle) - 1), np.clip(t, 0, len(shingle) - 1)
            has = ((self.shingle[p][:, :, None] == shingle[t][:, None, :]) & ok_t[:, None, :]).any(2)
            ok_p &= self.owner[p] == self.owner[place[lo : lo + 2000]][:, None]
            good[lo : lo + 2000] = (self.share[p] * (has & ok_p)).sum(1) >= self.need[place[lo : lo + 2000]] - 1e-9
        return good


def reach(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, step: int, edits: int, enough: int) -> list[np.ndarray]:
    """For 0 to ``edits`` edits, how many words of ``a`` from ``i`` on (or back) align with ``b`` from ``j``; up to ``enough``."""

    def slide(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x, y = x.copy(), y.copy()
        live = np.arange(len(x))
        for _ in range(enough):
            ok = (x[live] >= 0) & (x[live] < len(a)) & (y[live] >= 0) & (y[live] < len(b))
            live = live[ok]
            live = live[a[x[live]] == b[y[live]]]
            if not len(live):
                break
            x[live] += step
            y[live] += step
        return x, y

    fronts = [slide(i, j)]
    out = [(fronts[0][0] - i) * step]
    for _ in range(edits):
        fronts = [slide(x + dx * step, y + dy * step) for x, y in fronts for dx, dy in ((1, 1), (1, 0), (0, 1))]
        best = out[-1]
        for x, _ in fronts:
            best = np.maximum(best, (x - i) * step)
        out.append(best)
    return out


def aligned(passages: Passages, text: np.ndarray, at: np.ndarray, place: np.ndarray, min_words: int, max_edits: int) -> np.ndarray:
    """Whether a run of ``min_words`` passage words through ``(place, at)`` aligns with the text within ``max_edits`` edits."""
    a = passages.words
    right = reach(a, text, place, at, 1, max_edits, min_words)
    left = reach(a, text, place - 1, at - 1, -1, max_edits, min_words)
    owner = passages.owner[place]
    ends = np.searchsorted(passages.owner, owner, "right") - 1  # the passage's end mark
    starts = np.searchsorted(passages.owner, owner, "left")
    best = np.zeros(len(at), np.int64)
    for k in range(max_edits + 1):
        best = np.maximum(best, np.minimum(right[k], ends - place) + np.minimum(left[max_edits - k], place - starts))
    return best >= min_words


def _hashed(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Each slice of the batches with its texts' numbers of words and the hashes of all words."""
    for batch in slices(batches, text, SLICE):
        own = [words(t or "") for t in batch.column(text).to_pylist()]
        codes, hashes = word_hashes([w for t in own for w in t])
        yield batch, np.array([len(t) for t in own], np.int64), hashes[codes]


def word_lists(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, words array<long>)``: the hashes of each text's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, n, h in _hashed(batches, text):
            lists = pa.ListArray.from_arrays(np.r_[0, np.cumsum(n)].astype(np.int32), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(key), lists], names=[key, "words"])

    return rows.select(key, text).mapInArrow(run, f"{key} long, words array<long>")


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, numbers of words and word hashes, from texts or from word lists."""
    for batch in batches:
        if "text" in batch.schema.names:
            for part, n, h in _hashed(iter([batch]), "text"):
                yield part.column("doc_id").to_numpy(), n, h
            continue
        col = batch.column("words")
        ends = col.offsets.to_numpy()
        flat = col.values.to_numpy().view(np.uint64)
        lo = 0
        while lo < len(col):
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + SLICE // 6, "right")) - 1)
            yield batch.column("doc_id").to_numpy()[lo:hi], np.diff(ends[lo : hi + 1]), flat[ends[lo] : ends[hi]]
            lo = hi


def _proposed(p: Passages, h: np.ndarray, kinds: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in the text, places in the passages and distances of all candidate windows, each pair once."""
    found = []
    if "parts" in kinds:
        codes, distinct = pd.factorize(h)
        found.append(p.parts.candidates(fingerprints(codes, signs(distinct), p.part)))
    if "wholes" in kinds:
        s = shingles(h)
        found.append(p.wholes.candidates(weighted_fingerprints(s, p.weights(s), p.run - 1)))
    at, place, distance = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((distance, place, at))
    at, place, distance = at[order], place[order], distance[order]
    first = np.r_[True, (at[1:] != at[:-1]) | (place[1:] != place[:-1])] if len(at) else np.zeros(0, bool)
    return at[first], place[first], distance[first]


def _matches(p: Passages, n: np.ndarray, h: np.ndarray, min_words: int, max_edits: int, kinds: tuple[str, ...]) -> np.ndarray:
    """Distinct ``(text, item)`` numbers of the matches in texts of ``n`` words each."""
    ends = np.cumsum(n)
    h = np.insert(h, ends, END_OF_TEXT)  # parts the texts
    at, place, distance = _proposed(p, h, kinds)
    doc, item = np.searchsorted(ends + np.arange(1, len(n) + 1), at, "right"), p.owner[place]
    # of the windows along one diagonal only a run's first is aligned; equal windows and near ones form different runs
    order = np.lexsort((at, at - place, distance > 0, item, doc))
    at, place, doc, item, distance = at[order], place[order], doc[order], item[order], distance[order]
    follows = np.zeros(len(at), bool)
    follows[1:] = (doc[1:] == doc[:-1]) & (item[1:] == item[:-1]) & (at[1:] == at[:-1] + 1) & (place[1:] == place[:-1] + 1) & (distance[1:] == 0) & (distance[:-1] == 0)
    at, place, doc, item = at[~follows], place[~follows], doc[~follows], item[~follows]
    good = p.similar(shingles(h), at, place, max_edits + 1) if len(at) else np.zeros(0, bool)
    at, place, doc, item = at[good], place[good], doc[good], item[good]
    good = aligned(p, h, at, place, min_words, max_edits)
    return np.unique(np.stack([doc[good], item[good]], 1), axis=0)


def leaked(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, max_edits: int = MAX_EDITS, radius: int = RADIUS, max_words: int = MAX_WORDS_AT_ONCE, kinds: tuple[str, ...] = ("wholes", "parts"), cut: Cut | None = None) -> DataFrame:
    """``(doc_id, item_id)``, distinct: the document repeats part of the item's passage.

    ``documents``: ``(doc_id long, text string)``; ``items``: ``(item_id long, passage string)``; further columns are
    ignored. Words are runs of letters and digits; case, accents, punctuation and bracketed text don't matter. Null and
    empty texts and passages of fewer words match nothing; an id that occurs twice is reported once. Passages are
    broadcast in sets of about ``max_words`` words, and only one set at a time is on the driver; for a larger collection
    the corpus is split into words once, and each set passes over these.
    """
    spark = documents.sparkSession
    cut = cut or Cut(spark)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text is not null and text <> ''")
    held = word_lists(items.select(F.col("item_id").cast("long").alias("item_id"), "passage").filter("item_id is not null and passage is not null"), "item_id", "passage")
    held = cut.write(held.filter(F.size("words") >= min_words - max_edits))
    total = held.agg(F.sum(F.size("words"))).first()[0] or 0
    sets = [held]
    if total > max_words:
        texts = cut.write(word_lists(texts, "doc_id", "text"))
        numbered = cut.write(running(held, ["item_id", "words"], F.size("words"), "_words_before", cut).withColumn("_set", F.floor(F.col("_words_before") / max_words)))
        sets = [numbered.filter(F.col("_set") == k) for k in range(-(-total // max_words))]

    def search(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            p: Passages = shared.value
            for ids, n, h in _texts(batches):
                both = _matches(p, n, h, min_words, max_edits, kinds)
                if len(both):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[both[:, 0]]), pa.array(p.ids[both[:, 1]])], names=["doc_id", "item_id"])

        return run

    found = None
    for one in sets:
        rows = one.select("item_id", "words").toArrow()
        passages = Passages(rows.column("item_id").to_pylist(), [np.asarray(w.values.to_numpy()).view(np.uint64) for w in rows.column("words")], min_words, max_edits, radius)
        part = texts.mapInArrow(search(spark.sparkContext.broadcast(passages)), "doc_id long, item_id long")
        found = part if found is None else found.unionByName(part)
    return found.distinct()
