"""Places of many short queries in texts of bases, with bounded mismatches, in numpy."""

from __future__ import annotations

import numpy as np

# A, C, G, T as 0..3, anything else as 4.
CODES = np.full(256, 4, np.uint8)
CODES[np.frombuffer(b"ACGT", np.uint8)] = np.arange(4)
# Bits of the table that decides which places are looked up at all, and candidates compared at once.
TABLE_BITS = 20
COMPARED = 1 << 18


def folded(keys: np.ndarray) -> np.ndarray:
    """Keys as slots of the table."""
    return (keys ^ (keys >> TABLE_BITS) ^ (keys >> 2 * TABLE_BITS) ^ (keys >> 3 * TABLE_BITS)) & ((1 << TABLE_BITS) - 1)


class TileScanner:
    """Queries by their keys: for each query length the places of its seed that some key compares, any one of which agrees at a hit."""

    def __init__(self, queries: list[str], key_places: dict[int, list[list[int]]], mismatches: int, groups: np.ndarray | None = None) -> None:
        """With `groups`, a number from 0 per query, a query is found in texts of its group alone."""
        self.mismatches = mismatches
        self.length = np.array([len(q) for q in queries], np.int64)
        self.offset = np.cumsum(self.length) - self.length
        self.letters = CODES[np.frombuffer("".join(queries).encode(), np.uint8)]
        self.grouped = groups is not None
        # What a key holds besides its group fits 62 bits; fewer places find more candidates, which are compared in full.
        most = (62 - int(groups.max() + 1 if len(groups) else 1).bit_length()) // 2 if self.grouped else 31
        self.scans = []
        kinds = {n: {tuple(p[:most]) for p in kept} for n, kept in key_places.items()}
        for places in sorted(set().union(*kinds.values())):
            members = np.flatnonzero(np.isin(self.length, [n for n, kept in kinds.items() if places in kept]))
            keys = groups[members].astype(np.int64) if self.grouped else np.zeros(len(members), np.int64)
            for p in places:
                keys = keys * 4 + self.letters[self.offset[members] + p]
            order = np.argsort(keys, kind="stable")
            table = np.zeros(1 << TABLE_BITS, bool)
            table[folded(keys)] = True
            self.scans.append((places, keys[order], members[order], table))

    def places(self, texts: list[str], lead: np.ndarray, owned: np.ndarray, groups: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """(text, at, query, mismatches) of all hits that begin at one of the `owned` places behind `lead` and end in their text.

        `groups`: the group of each text, where the queries have groups.
        """
        sizes = np.array([len(t) for t in texts], np.int64)
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(texts) else sizes
        bases = CODES[np.frombuffer("".join(texts).encode("ascii", "replace"), np.uint8)]
        letters = bases & 3
        group = np.repeat(groups.astype(np.int64), sizes) if self.grouped else None
        hits = []
        for places, keys, members, table in self.scans:
            count = len(bases) - places[-1]
            if count <= 0:
                continue
            rolling = group[:count].copy() if self.grouped else np.zeros(count, np.int64 if len(places) > 15 else np.int32)
            for p in places:
                np.left_shift(rolling, 2, out=rolling)
                np.bitwise_or(rolling, letters[p:p + count], out=rolling)
            at = np.flatnonzero(table[folded(rolling) if self.grouped or len(places) * 2 > TABLE_BITS else rolling])
            low, high = np.searchsorted(keys, rolling[at], "left"), np.searchsorted(keys, rolling[at], "right")
            ends = np.cumsum(high - low)
            # Candidates are laid out for some places at a time.
            start = 0
            while start < len(at):
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + COMPARED, "right")))
                copies = (high - low)[start:stop]
                place = np.repeat(at[start:stop], copies)
                within = np.arange(len(place)) - np.repeat(np.cumsum(copies) - copies, copies)
                hits.append(self.compared(place, members[np.repeat(low[start:stop], copies) + within], bases, first, sizes, lead, owned))
                start = stop
        if not hits:
            return tuple(np.empty(0, np.int64) for _ in range(4))
        found = np.unique(np.concatenate(hits), axis=0)
        return found[:, 0], found[:, 1], found[:, 2], found[:, 3]

    def compared(self, place, query, bases, first, sizes, lead, owned) -> np.ndarray:
        """Hits among candidates as rows (text, at, query, mismatches)."""
        text = np.searchsorted(first, place, "right") - 1
        at = place - first[text]
        length = self.length[query]
        inside = (at >= lead[text]) & (at < lead[text] + owned[text]) & (at + length <= sizes[text])
        place, query, text, at, length = (x[inside] for x in (place, query, text, at, length))
        rows = [np.empty((0, 4), np.int64)]
        for n in np.unique(length):
            mine = np.flatnonzero(length == n)
            spelled = self.letters[self.offset[query[mine], None] + np.arange(n)]
            differing = (bases[place[mine, None] + np.arange(n)] != spelled).sum(axis=1)
            kept = differing <= self.mismatches
            rows.append(np.stack([text[mine][kept], at[mine][kept], query[mine][kept], differing[kept]], axis=1))
        return np.concatenate(rows)
