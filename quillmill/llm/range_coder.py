"""An adaptive context-mixing range coder for token ids, many blocks in step.

A frame holds the ids of whole documents, cut into blocks of equal length. Each block is coded on its own: it starts with a fresh coder
and a model reset to the frame's header, and carries a CRC-32 of its ids, so one damaged block harms no other. Three predictions are mixed:

* order 0: the distribution of all ids of the frame, from the header (frequencies of 2**16 in all);
* order 1: the id that followed the id before it when the block last saw that; at first the frame's most frequent one, from the header;
* order 2: the id that followed the two ids before it.

A guess of order 1 or 2 has a confidence, which rises when it is right and halves when it is wrong; a guess of low confidence is then
replaced. The guess is order 2's where that has proved itself, else order 1's. Each block learns, for every confidence of either order,
how often such guesses are right: these are the weights. An id is coded in one step, out of an interval of 2**26: in 1,024 shares, the
guess's by its weight, the rest order 0's.
The coder keeps 64 bits and gives out 32 at a time; where the upper 32 are not settled it narrows the interval instead of carrying.

All blocks of a frame take one step at once, as lanes of NumPy arrays: a step codes one id of every block.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

U = np.uint64
HALF, SHARE_BITS, TOTAL_BITS = U(32), 10, 16
SHARES, TOTAL = 1 << SHARE_BITS, 1 << TOTAL_BITS
ALL_BITS = U(SHARE_BITS + TOTAL_BITS)
LOW_MASK = U((1 << 32) - 1)
MAGIC = b"QMR3"
HEAD = "<QIII"
#: Slots of a block's contexts, confidences, the weights they begin with (of 2**16; order 1's, then order 2's), and how fast these are learned.
SLOT_BITS, LEVELS, RATE = 8, 8, 5
FIRST_WEIGHTS = np.array([10000, 10000, 15000, 22000, 30000, 36000, 42000, 48000, 10000, 15000, 32000, 42000, 48000, 52000, 55000, 60000], dtype=np.int32)
RISE = np.array([1, 1, 1, 1, 1, 1, 1, 0], dtype=np.int32)


class Prior:
    """Order 0 of a frame, and the most frequent successor of each id."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray, after: np.ndarray):
        """Distinct ids in order, their shares of TOTAL, their successors."""
        self.ids, self.counts = ids, counts
        ends = np.cumsum(counts)
        begins = np.zeros(TOTAL, dtype=np.uint64)
        widths = np.zeros(TOTAL, dtype=np.uint64)
        begins[ids], widths[ids] = ends - counts, counts
        self.part = (begins << HALF) | widths
        self.owner = np.repeat(ids.astype(np.uint16), counts)
        self.after = np.zeros(TOTAL, dtype=np.int32)
        self.after[ids] = after

    @classmethod
    def of(cls, ids: np.ndarray) -> "Prior":
        n = np.bincount(ids, minlength=TOTAL)
        held = np.flatnonzero(n)
        counts = np.maximum(1, n[held] * (TOTAL - len(held)) // len(ids))
        counts[np.argmax(counts)] += TOTAL - counts.sum()
        place = np.zeros(TOTAL, dtype=np.int64)
        place[held] = np.arange(len(held))
        kind = np.int32 if len(held) ** 2 < 1 << 31 else np.int64
        dense = place[ids].astype(kind)
        pairs, times = np.unique(dense[:-1] * kind(len(held)) + dense[1:], return_counts=True)
        pairs = pairs.astype(np.int64)[np.lexsort((-times, pairs // kind(len(held))))]
        first = np.flatnonzero(np.diff(pairs // len(held), prepend=-1))
        after = np.zeros(len(held), dtype=np.int64)
        after[pairs[first] // len(held)] = held[pairs[first] % len(held)]
        return cls(held, counts, after)

    def to_bytes(self) -> bytes:
        columns = [np.diff(self.ids, prepend=0), self.counts - 1, self.after[self.ids]]
        return zlib.compress(b"".join(c.astype("<u2").tobytes() for c in columns), 6)

    @classmethod
    def from_bytes(cls, raw: bytes) -> "Prior":
        gaps, counts, after = np.frombuffer(zlib.decompress(raw), dtype="<u2").reshape(3, -1).astype(np.int64)
        return cls(np.cumsum(gaps), counts + 1, after)


class Model:
    """Guesses and their weights for `lanes` blocks."""

    def __init__(self, lanes: int, prior: Prior):
        self.prior = prior
        self.base = np.arange(lanes, dtype=np.uint64) << U(SLOT_BITS)
        # guess << 3 | confidence, of order 1 and order 2; a confidence of 0 is no guess of the block's own
        self.slots1, self.slots2 = np.zeros(lanes << SLOT_BITS, dtype=np.int32), np.zeros(lanes << SLOT_BITS, dtype=np.int32)
        self.at1 = self.at2 = self.base.view(np.int64)
        self.weights, self.lane = np.tile(FIRST_WEIGHTS, lanes), np.arange(lanes) * len(FIRST_WEIGHTS)
        self.hash, self.last = np.zeros(lanes, dtype=np.uint64), np.zeros(lanes, dtype=np.int64)

    def guess(self) -> tuple[np.ndarray, np.ndarray]:
        """(the guess, its shares of SHARES): order 2's where it has a confidence of 2 or more, else order 1's."""
        self.held1, self.held2 = self.slots1.take(self.at1, mode="clip"), self.slots2.take(self.at2, mode="clip")
        self.level1, self.level2 = self.held1 & 7, self.held2 & 7
        second = self.level2 > 1
        guess = np.where(second, self.held2, self.held1) >> 3
        level = np.where(second, self.level2 + LEVELS, self.level1)
        new = np.flatnonzero(level == 0)
        guess[new] = self.prior.after.take(self.last.take(new), mode="clip")
        self.row = self.lane + level
        self.rate = self.weights.take(self.row, mode="clip")
        return guess, (self.rate * (SHARES - 24) >> 16) + 1

    def learn(self, ids: np.ndarray, right: np.ndarray) -> None:
        """ids as int64; lanes whose guess is right."""
        self.weights[self.row] = self.rate + ((right.astype(np.int32) << 16) - self.rate >> RATE)
        fresh = (ids << 3 | 1).astype(np.int32)
        for slots, at, held, level in ((self.slots1, self.at1, self.held1, self.level1), (self.slots2, self.at2, self.held2, self.level2)):
            same = (held ^ fresh) < 8
            slots[at] = np.where(same, held + RISE.take(level, mode="clip"), np.where(level < 2, fresh, held - (level >> 1)))
        new = ids.view(np.uint64) * U(0x9E3779B97F4A7C15)
        top = U(64 - SLOT_BITS)
        self.at1 = ((new >> top) | self.base).view(np.int64)
        self.at2 = ((((new ^ (self.hash >> U(7))) * U(0xC2B2AE3D27D4EB4F)) >> top) | self.base).view(np.int64)
        self.hash, self.last = new, ids

    def part(self, ids: np.ndarray, share: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, width) of each id's part of the interval; by: lanes where the guess codes it."""
        own = self.prior.part.take(ids, mode="clip")
        wide = share.astype(np.uint64)
        rest = U(SHARES) - wide
        wide <<= U(TOTAL_BITS)
        start, width = wide + (own >> HALF) * rest, (own & LOW_MASK) * rest
        start[by], width[by] = 0, wide[by]
        return start, width


def _settled(low: np.ndarray, rng: np.ndarray) -> np.ndarray:
    """The lanes that give out 32 bits; their intervals are narrowed to one value of these."""
    due = np.flatnonzero(rng <= LOW_MASK)
    a, r = low[due], rng[due]
    rng[due] = np.where((a >> HALF) != ((a + r - U(1)) >> HALF), U(1 << 32) - (a & LOW_MASK), r) << HALF
    return due


def _encode_lanes(grid: np.ndarray, prior: Prior) -> list[bytes]:
    """grid: blocks x ids."""
    lanes, steps = grid.shape
    m, low, rng = Model(lanes, prior), np.zeros(lanes, dtype=np.uint64), np.full(lanes, (1 << 64) - 1, dtype=np.uint64)
    words = steps + 4
    out, pos = np.zeros(lanes * words, dtype="<u4"), np.arange(lanes) * words
    for plain in np.ascontiguousarray(grid.T):
        ids = plain.astype(np.int64)
        guess, share = m.guess()
        right = guess == ids
        start, width = m.part(ids, share, np.flatnonzero(right))
        rng >>= ALL_BITS
        low += start * rng
        rng *= width
        due = _settled(low, rng)
        a, p = low[due], pos[due]
        out[p] = a >> HALF
        pos[due] = p + 1
        low[due] = a << HALF
        m.learn(ids, right)
    for shift in (HALF, U(0)):
        out[pos] = (low >> shift) & LOW_MASK
        pos += 1
    return [out[i * words : pos[i]].tobytes() for i in range(lanes)]


def _decode_lanes(blocks: list[bytes], steps: int, prior: Prior) -> np.ndarray:
    lanes = len(blocks)
    ends = np.cumsum([len(b) // 4 for b in blocks])
    source = np.concatenate([np.frombuffer(b"".join(b[: len(b) // 4 * 4] for b in blocks), dtype="<u4").astype(np.uint64), np.zeros(8, dtype=np.uint64)])
    pos = np.concatenate([[0], ends[:-1]])
    m, low, rng = Model(lanes, prior), np.zeros(lanes, dtype=np.uint64), np.full(lanes, (1 << 64) - 1, dtype=np.uint64)
    code, pos = (source.take(pos, mode="clip") << HALF) | source.take(pos + 1, mode="clip"), pos + 2
    grid = np.zeros((steps, lanes), dtype="<u2")
    for step in range(steps):
        guess, share = m.guess()
        rng >>= ALL_BITS
        t = np.minimum((code - low) // rng, U((1 << int(ALL_BITS)) - 1)).view(np.int64)
        by = np.flatnonzero(t >> TOTAL_BITS < share)
        # the quotient is far from the next whole number if it is none, so floats give it exactly
        ids = prior.owner.take(((t - (share.astype(np.int64) << TOTAL_BITS)) / (SHARES - share)).astype(np.int64), mode="clip").astype(np.int64)
        ids[by] = guess[by]
        start, width = m.part(ids, share, by)
        low += start * rng
        rng *= width
        due = _settled(low, rng)
        low[due] <<= HALF
        p = pos[due]
        code[due] = (code[due] << HALF) | source.take(p, mode="clip")  # damaged blocks may ask for more
        pos[due] = p + 1
        grid[step] = ids
        m.learn(ids, guess == ids)
    return np.ascontiguousarray(grid.T)


def block_length(n: int) -> int:
    """Ids to a block: about 4,096 blocks a frame, of 1,024 to 4,096 ids."""
    return int(min(4096, max(1024, -(-n // 4096))))


def encode(ids: np.ndarray) -> bytes:
    """A frame: magic, number of ids, block length, length and crc of the prior, the prior, then (length, crc) of each block, then the blocks."""
    n = len(ids)
    if not n:
        return MAGIC + struct.pack(HEAD, 0, 1, 0, 0)
    size = min(block_length(n), n)
    grid = np.full(-(-n // size) * size, ids[-1], dtype="<u2")
    grid[:n] = ids
    grid = grid.reshape(-1, size)
    prior = Prior.of(grid.ravel())
    blocks = _encode_lanes(grid, prior)
    heads = [struct.pack("<II", len(b), zlib.crc32(g.tobytes())) for b, g in zip(blocks, grid)]
    told = prior.to_bytes()
    return b"".join([MAGIC, struct.pack(HEAD, n, size, len(told), zlib.crc32(told)), told, *heads, *blocks])


def decode(frame: bytes) -> np.ndarray:
    """The ids of a frame; ValueError names what is damaged, the prior or the first block whose checksum fails."""
    if frame[:4] != MAGIC:
        raise ValueError("not a frame of ids")
    n, size, told, crc = struct.unpack_from(HEAD, frame, 4)
    if not n:
        return np.zeros(0, dtype="<u2")
    at = 4 + struct.calcsize(HEAD)
    if zlib.crc32(frame[at : at + told]) != crc:
        raise ValueError("the prior is damaged")
    prior, at = Prior.from_bytes(frame[at : at + told]), at + told
    count = -(-n // size)
    heads = [struct.unpack_from("<II", frame, at + 8 * i) for i in range(count)]
    at, blocks = at + 8 * count, []
    for length, _ in heads:
        blocks.append(frame[at : at + length])
        at += length
    grid = _decode_lanes(blocks, size, prior)
    for i, (_, crc) in enumerate(heads):
        if zlib.crc32(grid[i].tobytes()) != crc:
            raise ValueError(f"block {i} is damaged")
    return grid.reshape(-1)[:n]
