"""Sequences that begin loci, and which of them a sequence is alike, place by place."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

WIDTH = 8
CELLS = 1 << 16
#: Lengths of alike sequences differ at most in this ratio, whatever the identity asked for.
LENGTHS = 0.6


def _matrix(texts: list[bytes]) -> np.ndarray:
    """The letters of the texts, a row each, filled up with zeros."""
    width = max(map(len, texts))
    return np.frombuffer(b"".join(t.ljust(width, b"\0") for t in texts), np.uint8).reshape(len(texts), width)


def _planes(letters: np.ndarray) -> np.ndarray:
    """``(word, 2, row)``: two bits a letter, which tell A, C, G and T apart, in words of 64 places.

    Places with different bits hold different letters; other letters, and the end of a text, can have equal bits.
    """
    bits = np.zeros((2, len(letters), -(-letters.shape[1] // 64) * 64), np.uint8)
    bits[0, :, : letters.shape[1]] = letters >> 1 & 1
    bits[1, :, : letters.shape[1]] = letters >> 2 & 1
    return np.ascontiguousarray(np.packbits(bits, axis=2).view(np.uint64).transpose(2, 0, 1))


class _Bucket:
    """Texts of nearly one length in the order of their numbers."""

    def __init__(self, nos: np.ndarray, lengths: np.ndarray, letters: np.ndarray):
        self.nos, self.lengths, self.letters = nos, lengths, letters
        self.low, self.high = int(lengths.min()), int(lengths.max())
        self._bits: np.ndarray | None = None

    def __getstate__(self) -> tuple:
        return self.nos, self.lengths, self.letters

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    @property
    def bits(self) -> np.ndarray:
        if self._bits is None:
            self._bits = _planes(self.letters)
        return self._bits

    def with_more(self, more: _Bucket) -> _Bucket:
        letters = np.zeros((len(self.nos) + len(more.nos), max(self.letters.shape[1], more.letters.shape[1])), np.uint8)
        letters[: len(self.nos), : self.letters.shape[1]] = self.letters
        letters[len(self.nos) :, : more.letters.shape[1]] = more.letters
        return _Bucket(np.concatenate([self.nos, more.nos]), np.concatenate([self.lengths, more.lengths]), letters)


def _buckets(nos: Sequence[int], texts: Sequence[str]) -> dict[int, _Bucket]:
    nos, coded = np.asarray(nos, np.int64), [t.encode() for t in texts]
    lengths = np.fromiter(map(len, coded), np.int64, len(coded))
    order = np.lexsort((nos, lengths // WIDTH))
    out = {}
    for own in np.split(order, np.flatnonzero(np.diff(lengths[order] // WIDTH)) + 1) if len(order) else []:
        out[int(lengths[own[0]] // WIDTH)] = _Bucket(nos[own], lengths[own], _matrix([coded[k] for k in own]))
    return out


class Loci:
    """Numbered and named sequences, by length; ``add`` takes ever greater numbers.

    Two sequences are alike when they agree in ``identity`` of the letters of the longer one, place by place. Pairs are
    compared by bits: so many places at the beginning that by chance almost none keeps within the differences allowed
    for all places; those that do are compared letter by letter. No alike pair is lost.
    """

    def __init__(self, identity: float):
        self.identity, self.buckets = identity, {}
        self.nos, self.names = np.zeros(0, np.int64), []

    def add(self, nos: Sequence[int], texts: Sequence[str], names: Sequence[str]) -> None:
        for key, own in _buckets(nos, texts).items():
            self.buckets[key] = self.buckets[key].with_more(own) if key in self.buckets else own
        self.nos = np.concatenate([self.nos, np.asarray(nos, np.int64)])
        self.names.extend(names)

    def name(self, no: int) -> str:
        return self.names[int(np.searchsorted(self.nos, no))]

    def _pairs(self, own: _Bucket, other: _Bucket) -> list[tuple[np.ndarray, np.ndarray]]:
        """The pairs of places in ``own`` and ``other`` that are alike, the other one of the smaller number."""
        free = (1 - self.identity) * max(own.high, other.high) + 1e-6
        apart = max(0, own.low - other.high, other.low - own.high)
        if apart > free or min(own.high, other.high) < LENGTHS * max(own.low, other.low):
            return []
        words, inside = min(len(own.bits), len(other.bits)), min(own.low, other.low) // 64
        least = int(free)
        for w in range(1, words + 1):
            allowed = int(free - apart) if w <= inside else int(free)
            if 48 * w - 3 * (12 * w) ** 0.5 > allowed:  # by chance three letters of four differ
                words, least = w, allowed
                break
        kind, out, start = np.uint8 if words < 4 else np.uint32, [], 0
        while start < len(own.nos):
            n = int(np.searchsorted(other.nos, own.nos[start]))
            end = min(len(own.nos), start + max(1, CELLS // max(1, n)))
            n = int(np.searchsorted(other.nos, own.nos[end - 1]))
            if n:
                far = np.zeros((end - start, n), kind)
                for w in range(words):
                    differ = own.bits[w, 0, start:end, None] ^ other.bits[w, 0, None, :n]
                    differ |= own.bits[w, 1, start:end, None] ^ other.bits[w, 1, None, :n]
                    far += np.bitwise_count(differ)
                near = np.flatnonzero(far <= least)
                if len(near):
                    a, b = np.divmod(near, n)
                    a += start
                    keep = self._alike(own, other, a, b)
                    out.append((a[keep], b[keep]))
            start = end
        return out

    def _alike(self, own: _Bucket, other: _Bucket, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        width = min(own.letters.shape[1], other.letters.shape[1])
        keep = np.zeros(len(a), bool)
        for k in range(0, len(a), CELLS):
            i, j = a[k : k + CELLS], b[k : k + CELLS]
            most = np.maximum(own.lengths[i], other.lengths[j])
            equal = np.minimum(most, width) - (own.letters[i, :width] != other.letters[j, :width]).sum(1)
            with np.errstate(invalid="ignore"):
                alike = (equal / most >= self.identity) & (np.minimum(own.lengths[i], other.lengths[j]) / most >= LENGTHS)
            keep[k : k + CELLS] = alike & (other.nos[j] < own.nos[i])
        return keep

    def first(self, nos: Sequence[int], texts: Sequence[str]) -> dict[int, int]:
        """The least number that a text is alike, of those less than its own, by number."""
        out: dict[int, int] = {}
        for own in _buckets(nos, texts).values():
            least = np.full(len(own.nos), np.iinfo(np.int64).max)
            for other in self.buckets.values():
                for a, b in self._pairs(own, other):
                    np.minimum.at(least, a, other.nos[b])
            found = least < np.iinfo(np.int64).max
            out.update(zip(own.nos[found].tolist(), least[found].tolist()))
        return out

    def every(self, nos: Sequence[int], texts: Sequence[str], most: int) -> dict[int, list[int]]:
        """The least numbers, up to ``most``, that a text is alike, of those less than its own, in order, by number."""
        out: dict[int, list[int]] = {}
        for own in _buckets(nos, texts).values():
            met = [(a, other.nos[b]) for other in self.buckets.values() for a, b in self._pairs(own, other)]
            met = [m for m in met if len(m[0])]
            if not met:
                continue
            a, b = np.concatenate([m[0] for m in met]), np.concatenate([m[1] for m in met])
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            for k in np.split(np.arange(len(a)), np.flatnonzero(np.diff(a)) + 1):
                out[int(own.nos[a[k[0]]])] = b[k[:most]].tolist()
        return out
