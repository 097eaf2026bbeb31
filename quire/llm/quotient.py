"""A counting quotient filter over 64-bit fingerprints, in numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


class CountingQuotientFilter:
    """Fingerprints as quotient runs of sorted remainders, each with a counter.

    A fingerprint's high ``quotient_bits`` select the run, the rest is its
    remainder. Entries stand in order of quotient and remainder; an entry names
    its quotient, so that a filter takes room by its entries and not by its
    quotients. It keeps whole remainders, so it is exact over fingerprints, and
    filters of one geometry merge without loss.
    """

    def __init__(self, quotient_bits: int, quotients: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.quotient_bits = quotient_bits
        self.quotients = quotients
        self.remainders = remainders
        self.counts = counts

    @classmethod
    def build(cls, fingerprints: np.ndarray, quotient_bits: int) -> CountingQuotientFilter:
        distinct, counts = np.unique(fingerprints, return_counts=True)
        shift = np.uint64(64 - quotient_bits)
        mask = np.uint64((1 << (64 - quotient_bits)) - 1)
        return cls(quotient_bits, distinct >> shift, distinct & mask, counts.astype(np.int64))

    def fingerprints(self) -> np.ndarray:
        return (self.quotients << np.uint64(64 - self.quotient_bits)) | self.remainders

    def merge(self, *others: CountingQuotientFilter) -> CountingQuotientFilter:
        """The filter of all fingerprints together.

        Filters merge two by two, the pairs of a round before those of the
        next, so that an entry moves once per round.
        """
        filters = [self, *others]
        if any(x.quotient_bits != self.quotient_bits for x in filters):
            raise ValueError("filters of different geometry don't merge")
        while len(filters) > 1:
            pairs = zip(filters[::2], filters[1::2], strict=False)
            filters = [a._with(b) for a, b in pairs] + filters[len(filters) // 2 * 2 :]
        return filters[0]

    def _with(self, other: CountingQuotientFilter) -> CountingQuotientFilter:
        """Two filters as one: runs of one quotient are merged by their sorted remainders, counters of equal ones added."""
        own, new = self.fingerprints(), other.fingerprints()  # in order of quotient, then remainder
        at = np.searchsorted(own, new)
        known = np.zeros(len(new), bool)
        inside = at < len(own)
        known[inside] = own[at[inside]] == new[inside]
        counts = self.counts.copy()
        counts[at[known]] += other.counts[known]
        fresh = ~known
        places = at[fresh] + np.arange(int(fresh.sum()))
        held = np.ones(len(own) + len(places), bool)
        held[places] = False

        def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            out = np.empty(len(held), a.dtype)
            out[held], out[places] = a, b[fresh]
            return out

        return CountingQuotientFilter(
            self.quotient_bits, joined(self.quotients, other.quotients), joined(self.remainders, other.remainders), joined(counts, other.counts)
        )

    def count(self, fingerprint: int) -> int:
        quotient = np.uint64(fingerprint >> (64 - self.quotient_bits))
        remainder = np.uint64(fingerprint & ((1 << (64 - self.quotient_bits)) - 1))
        start, end = np.searchsorted(self.quotients, quotient), np.searchsorted(self.quotients, quotient, "right")
        at = int(start + np.searchsorted(self.remainders[start:end], remainder))
        return int(self.counts[at]) if at < end and self.remainders[at] == remainder else 0

    def segments(self, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Splits into (segment number, quotients in it, remainders, counts) by the quotient's high ``bits``."""
        low = np.uint64(self.quotient_bits - bits)
        numbers = self.quotients >> low
        inner = self.quotients & ((np.uint64(1) << low) - np.uint64(1))
        starts = np.flatnonzero(np.r_[True, numbers[1:] != numbers[:-1]]) if len(numbers) else np.zeros(0, np.int64)
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(numbers)], strict=False):
            yield int(numbers[a]), inner[a:b], self.remainders[a:b], self.counts[a:b]
