"""Adaptive context-mixing range coder for token ids; a block is coded as many lanes side by side that share one model.

Integers only, so every machine decodes what any other has encoded. Each block starts from a fresh
model and carries a checksum, so it can be read alone. Its lanes, runs of its ids, advance together, one id
a step, and all learn into the same tables. A lane's next id is predicted by the id that
followed its last two ids (order 2) and its last id (order 1), each with a confidence. Shares learned for
each pair of confidences mix the two guesses with order 0, the block's own counts of all ids, which
codes what neither of them guessed.
"""

from __future__ import annotations

import zlib

import numpy as np

#: Ids of a block, at most; they bound the memory of a task.
BLOCK = 1 << 21
#: Lanes of a block, at most, and ids of a lane where a block has fewer lanes.
LANES, LANE_IDS = 4096, 512
TOP, BOTTOM, WORD = np.uint64(1 << 48), np.uint64(1 << 32), np.uint64(48)
SCALE_BITS = 16
#: Steps until shares and order 0 are renewed, the first ones apart.
REFRESH = 16
#: Weight of one occurrence in order 0, where every id starts with 1.
SEEN = 32
#: Cells of a context table hold an id and above it the confidence, at most 7.
ID, TRUSTED = 0xFFFF, 7 << 16


class Coder:
    """Carry-less range coder over 16-bit words, many lanes side by side."""

    def __init__(self, lanes: int) -> None:
        self.low = np.zeros(lanes, np.uint64)
        self.range = np.full(lanes, (1 << 64) - 1, np.uint64)

    def narrow(self, at: np.ndarray | slice, cum: np.ndarray, freq: np.ndarray, unit: np.ndarray) -> None:
        low = self.low[at] + cum * unit
        width = freq * unit
        self.low[at], self.range[at] = low, width
        shift = np.flatnonzero(width < BOTTOM)
        lanes = shift if isinstance(at, slice) else at[shift]
        low, width = low[shift], width[shift]
        while len(lanes):
            # Where the upper word is not settled yet, the width is cut at the next multiple of BOTTOM.
            width = np.where((low ^ (low + width)) < TOP, width, (~low + np.uint64(1)) & (BOTTOM - np.uint64(1)))
            self.word(lanes, low >> WORD)
            low, width = low << np.uint64(16), width << np.uint64(16)
            self.low[lanes], self.range[lanes] = low, width
            again = np.flatnonzero(width < BOTTOM)
            lanes, low, width = lanes[again], low[again], width[again]

    def word(self, at: np.ndarray, value: np.ndarray) -> None:
        raise NotImplementedError


class Writer(Coder):
    def __init__(self, lanes: int, longest: int) -> None:
        super().__init__(lanes)
        self.words = np.zeros((lanes, 2 * longest + 64), np.uint16)
        self.used = np.zeros(lanes, np.int64)

    def word(self, at: np.ndarray, value: np.ndarray) -> None:
        used = self.used[at]
        if used.max() >= self.words.shape[1]:
            self.words = np.concatenate([self.words, np.zeros_like(self.words)], axis=1)
        self.words[at, used] = value
        self.used[at] = used + 1

    def finish(self) -> tuple[np.ndarray, np.ndarray]:
        """(words of all lanes, words of each). Two more settle a lane: its width is at least 2^32, zeros may follow."""
        lanes = np.arange(len(self.low))
        value = self.low + (BOTTOM - np.uint64(1))
        for shift in (48, 32):
            self.word(lanes, (value >> np.uint64(shift)) & np.uint64(0xFFFF))
        return self.words[np.arange(self.words.shape[1]) < self.used[:, None]], self.used


class Reader(Coder):
    def __init__(self, words: np.ndarray, used: np.ndarray) -> None:
        super().__init__(len(used))
        self.words = np.zeros((len(used), int(used.max()) + 64), np.uint16)
        self.words[np.arange(self.words.shape[1]) < used[:, None]] = words
        self.used = np.full(len(used), 4, np.int64)
        self.value = np.zeros(len(used), np.uint64)
        for i in range(4):
            self.value = (self.value << np.uint64(16)) | self.words[:, i]

    def word(self, at: np.ndarray, value: np.ndarray) -> None:
        used = self.used[at]
        self.value[at] = (self.value[at] << np.uint64(16)) | self.words[at, np.minimum(used, self.words.shape[1] - 1)]
        self.used[at] = used + 1


class Shares:
    """Learned shares of the three slots (order 2, order 1, the rest) for each pair of confidences and whether the guesses agree."""

    def __init__(self) -> None:
        self.counts = np.ones((128, 3), np.int64)
        self.renew()

    def renew(self) -> None:
        spread = (1 << SCALE_BITS) - 3
        freq = 1 + self.counts * spread // self.counts.sum(axis=1, keepdims=True)
        freq[:, 2] += (1 << SCALE_BITS) - freq.sum(axis=1)
        self.freq, self.ends = freq.astype(np.uint64).ravel(), np.cumsum(freq, axis=1).astype(np.uint64)
        self.begin = self.ends.ravel() - self.freq
        self.first, self.second = self.ends[:, 0].copy(), self.ends[:, 1].copy()

    def learn(self, cells: list[np.ndarray]) -> None:
        self.counts += np.bincount(np.concatenate(cells), minlength=384).reshape(128, 3)
        self.renew()


class Counts:
    """Order 0: counts of all ids, with running sums and the id that stands at the start of each equal part of the total."""

    def __init__(self) -> None:
        self.counts, self.sums = np.ones(1 << 16, np.int64), np.zeros((1 << 16) + 1, np.int32)
        self.renew()

    def renew(self) -> None:
        np.cumsum(self.counts, out=self.sums[1:])
        self.total = np.uint64(self.sums[-1])
        self.part = max(0, int(self.total).bit_length() - 15)
        self.starts = None

    def learn(self, ids: list[np.ndarray]) -> None:
        if ids:
            self.counts += np.bincount(np.concatenate(ids), minlength=1 << 16) * SEEN
            self.renew()

    def find(self, target: np.ndarray) -> np.ndarray:
        if self.starts is None:
            firsts = np.arange(0, int(self.total), 1 << self.part, dtype=np.int32)
            self.starts = np.searchsorted(self.sums, firsts, side="right") - 1
        target = target.astype(np.int32)
        found = self.starts.take(target >> self.part)
        for _ in range(2):
            found += self.sums.take(found + 1) <= target
        late = np.flatnonzero(self.sums.take(found + 1) <= target)
        if len(late):
            found[late] = np.searchsorted(self.sums, target[late], side="right") - 1
        return found


def lanes_of(n: int) -> np.ndarray:
    """Ids of each lane of a block of n ids: at most one apart, falling."""
    lanes = max(1, min(LANES, n // LANE_IDS))
    return n // lanes + (np.arange(lanes) < n % lanes)


def run(coder: Coder, lengths: np.ndarray, ids: np.ndarray | None) -> np.ndarray:
    """Code the lanes' ids (lanes of falling length; a row per step), or find them where `ids` is None."""
    lanes, longest = len(lengths), int(lengths[0])
    out = np.zeros((longest, lanes), np.uint16)
    bits = min(20, max(8, int(lengths.sum()).bit_length()))
    pairs, singles = np.zeros(1 << bits, np.int32), np.zeros(1 << 16, np.int32)
    counts = Counts()
    shares, scale = Shares(), np.uint64(SCALE_BITS)
    spread, down = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - bits)
    one, two = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    cells, rests = [], []
    for step in range(longest):
        if step in (1, 2, 4, 8) or step and step % REFRESH == 0:
            shares.learn(cells)
            counts.learn(rests)
            cells, rests = [], []
        live = lanes if step < lengths[-1] else int(np.searchsorted(-lengths, -step, side="left"))
        at = slice(0, live)
        a, b = one[:live], two[:live]
        pair = ((((a << 16) | b).astype(np.uint64) * spread) >> down).astype(np.int64)
        c2, c1 = pairs.take(pair), singles.take(a)
        g2, g1 = c2 & ID, c1 & ID
        joint = (((c2 >> 16) << 4) | ((c1 >> 16) << 1) | (g2 == g1)).astype(np.int64)
        unit = coder.range[at] >> scale
        if ids is None:
            found = coder.value[at] - coder.low[at]
            slot = (found >= shares.first.take(joint) * unit).astype(np.int64) + (found >= shares.second.take(joint) * unit)
        else:
            x = ids[step, :live].astype(np.int32)
            slot = (x != g2) * (1 + (x != g1).astype(np.int64))
        cell = joint * 3 + slot
        coder.narrow(at, shares.begin.take(cell), shares.freq.take(cell), unit)
        other = np.flatnonzero(slot == 2)
        if ids is None:
            x = np.where(slot == 0, g2, g1)
        if len(other):
            unit = coder.range[other] // counts.total
            if ids is None:
                x[other] = counts.find(np.minimum((coder.value[other] - coder.low[other]) // unit, counts.total - np.uint64(1)))
            rest = x[other].astype(np.int64)
            begin = counts.sums.take(rest)
            coder.narrow(other, begin.astype(np.uint64), (counts.sums.take(rest + 1) - begin).astype(np.uint64), unit)
            rests.append(rest)
        out[step, :live] = x
        cells.append(cell)
        # Of contexts that meet in one step the last lane's is kept.
        pairs[pair] = learned(c2, x == g2, x)
        singles[a] = learned(c1, x == g1, x)
        two[:live], one[:live] = a.copy(), x
    return out


def learned(cell: np.ndarray, hit: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cells after an id: a hit gains confidence, a miss halves it, without any the id takes the cell."""
    up = np.where(cell < TRUSTED, cell + (1 << 16), cell)
    missed = np.where(cell > ID, (cell & ID) | ((cell >> 17) << 16), x)
    return np.where(hit, up, missed)


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """Each block of ids below 65,536 as bytes: count, checksum of the ids, words of each lane, coded words."""
    out = []
    for block in blocks:
        if len(block) > BLOCK:
            raise ValueError(f"a block holds at most {BLOCK} ids")
        lengths = lanes_of(len(block))
        ids = np.zeros((len(lengths), int(lengths[0])), np.uint16)
        ids[np.arange(ids.shape[1]) < lengths[:, None]] = block
        writer = Writer(len(lengths), ids.shape[1])
        run(writer, lengths, np.ascontiguousarray(ids.T))
        words, used = writer.finish()
        head = np.array([len(block), zlib.crc32(block.astype("<u2").tobytes())], "<u4").tobytes()
        out.append(head + used.astype("<u2").tobytes() + words.astype("<u2").tobytes())
    return out


def decode_blocks(payloads: list[bytes]) -> list[np.ndarray]:
    """The ids of each block; a block that does not match its checksum is an error."""
    out = []
    for payload in payloads:
        n, crc = (int(v) for v in np.frombuffer(payload[:8], "<u4"))
        lengths = lanes_of(n)
        words = np.frombuffer(payload[8:], "<u2")
        used, words = words[:len(lengths)].astype(np.int64), words[len(lengths):]
        ids = None
        if len(used) == len(lengths) and used.sum() == len(words):
            found = run(Reader(words, used), lengths, None).T
            ids = found[np.arange(found.shape[1]) < lengths[:, None]]
        if ids is None or zlib.crc32(ids.astype("<u2").tobytes()) != crc:
            raise ValueError("a block of token ids is damaged: its checksum differs")
        out.append(ids)
    return out
