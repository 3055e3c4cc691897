"""How much windows of one text have in common: a helper for the arrays of one row, in NumPy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

NEAR = "array<struct<jaccard:double,other:int>>"
#: Cells of the table of classes by classes that is held at once.
CELLS = 4_000_000


def _expand(low: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, low[i] + 0 .. count[i] - 1) for every i."""
    who = np.repeat(np.arange(len(low)), count)
    return who, np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count) + low[who]


def similar(grams: np.ndarray, total: int, size: int, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """(jaccard, other) of each window of a text of `total` words: its most similar window at least two away, the first of equals; -1 where none has a gram in common.

    Windows with equal grams are one class, of which the first four are enough, for at most three lie too near to any one; grams
    that stand in the same classes are counted together. Of the table of classes by classes a part is held at a time.
    """
    n = total - len(grams) + 1
    count = 1 if total <= size else -(-(total - size) // stride) + 1
    best, other = np.zeros(count), np.full(count, -1)
    order = np.argsort(grams, kind="stable")
    same = np.concatenate([[False], grams[order][1:] == grams[order][:-1]])
    code, before = np.empty(len(grams), np.int64), np.full(len(grams), -1)
    code[order] = np.cumsum(~same) - 1
    before[order[same]] = order[np.flatnonzero(same) - 1]
    # the different grams of each window: those whose place before lies ahead of it
    place = np.arange(len(grams))
    low = np.maximum(0, -((size - n - place) // stride))
    who, win = _expand(low, np.maximum(0, np.minimum(count - 1, place // stride) - low + 1))
    first = before[who] < win * stride
    who, win = code[who[first]], win[first]
    sizes = np.bincount(win, minlength=count)
    least, most = np.full(code.max() + 1, count), np.full(code.max() + 1, -1)
    np.minimum.at(least, who, win)
    np.maximum.at(most, who, win)
    wide = most - least >= 2
    if not wide.any():
        return best, other
    key = np.zeros(count, np.uint64)
    value = np.empty(len(wide), np.uint64)
    value[code] = grams.view(np.uint64)
    np.add.at(key, win, value[who])
    there = np.flatnonzero(sizes)
    _, lead, cls = np.unique(key[there], return_index=True, return_inverse=True)
    k, lead = len(lead), there[lead]
    by = np.argsort(cls, kind="stable")
    members = np.split(there[by], np.cumsum(np.bincount(cls))[:-1])
    firsts = np.full((k, 4), -1)
    for c, m in enumerate(members):
        firsts[c, : min(4, len(m))] = m[:4]
    # the classes that each gram stands in, and how many grams stand in the same ones
    of = np.full(count, -1)
    of[lead] = np.arange(k)
    held = wide[who] & (of[win] >= 0)
    gram, c = who[held], of[win[held]]
    by = np.lexsort((c, gram))
    gram, c = gram[by], c[by]
    start = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
    marks = np.random.default_rng(0).integers(0, 2**63, k, dtype=np.uint64)
    _, some, times = np.unique(np.add.reduceat(marks[c], start), return_index=True, return_counts=True)
    begin, length = start[some], np.diff(np.append(start, len(gram)))[some]
    set_, at = _expand(begin, length)
    own = c[at]
    by = np.argsort(own, kind="stable")
    set_, own = set_[by], own[by]
    rows = min(k, max(1, CELLS // k))
    for r in range(0, k, rows):
        a, z = np.searchsorted(own, [r, r + rows])
        both = np.zeros(rows * k)
        cost = np.cumsum(length[set_[a:z]])
        while a < z:
            stop = a + max(1, int(np.searchsorted(cost, CELLS, side="right")))  # sets whose pairs fit
            i, j = _expand(begin[set_[a:stop]], length[set_[a:stop]])
            np.add.at(both, (own[a:stop][i] - r) * k + c[j], times[set_[a:stop]][i])
            cost, a = cost[stop - a :] - cost[min(stop, z) - a - 1], stop
        for x, line in enumerate(both.reshape(rows, k)[: k - r], r):
            line[x] = 0
            met = np.flatnonzero(line)
            rate = line[met] / (sizes[lead[x]] + sizes[lead[met]] - line[met])
            if len(members[x]) > 1:
                met, rate = np.append(met, x), np.append(rate, 1.0)
            for w in members[x] if len(met) else ():
                far = (firsts[met] >= 0) & (np.abs(firsts[met] - w) >= 2)
                has = far.any(1)
                if has.any():
                    o = firsts[met][np.arange(len(met)), far.argmax(1)]
                    top = np.lexsort((o[has], -rate[has]))[0]
                    best[w], other[w] = rate[has][top], o[has][top]
    return best, other


def most_similar(grams: Column, total: Column, size: int, stride: int) -> Column:
    """For each window, struct(jaccard, other) as in similar(), null where there is none; null for null grams."""

    @F.arrow_udf(NEAR)
    def near(grams: pa.Array, total: pa.Array) -> pa.Array:
        out = []
        for g, t in zip(grams, total):
            if not g.is_valid or not len(g.values):
                out.append(None)
                continue
            best, other = similar(g.values.to_numpy(zero_copy_only=False), t.as_py(), size, stride)
            out.append([{"jaccard": b, "other": o} if o >= 0 else None for b, o in zip(best.tolist(), other.tolist())] if (other >= 0).any() else None)
        return pa.array(out, pa.list_(pa.struct([("jaccard", pa.float64()), ("other", pa.int32())])))

    return near(grams, total)
