"""Where the names of one text stand in its sentences: a helper for the arrays of one row."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

PLACES = "array<struct<mentions:int,places:array<int>>>"
RUN, LETTERS = re.compile("[A-Z][a-z]{2,}"), re.compile("[a-z]{3,}")
#: Letters of a name by which it is looked up.
HEAD = 3


def mentioned(names: list[str], sentences: list[str], weights: list[int], most: int) -> list[tuple[int, list[int]]]:
    """For each name, a capital and two small letters or more: how often it stands in the sentences, inside longer words too, and the numbers of up to `most` sentences that hold it in any case, the heavier first, then the earlier.

    A name lies within one run of letters. So the different runs are made once, with the first sentences of each, and names are looked up by
    every run's parts.
    """
    sizes = defaultdict(set)
    for n in names:
        sizes[n[:HEAD].lower()].add(len(n))
    sizes = {h: sorted(s) for h, s in sizes.items()}
    count = Counter()
    for run, times in Counter(RUN.findall("\n".join(sentences))).items():
        for size in sizes.get(run[:HEAD].lower(), ()):
            if size > len(run):
                break
            count[run[:size]] += times
    order = sorted(range(len(sentences)), key=lambda i: -weights[i])
    held = defaultdict(list)
    for rank, i in enumerate(order):
        for run in set(LETTERS.findall(sentences[i].lower())):
            ranks = held[run]
            if len(ranks) < most:
                ranks.append(rank)
    best = defaultdict(set)
    for run, ranks in held.items():
        for a in range(len(run) - HEAD + 1):
            for size in sizes.get(run[a : a + HEAD], ()):
                if a + size > len(run):
                    break
                best[run[a : a + size]].update(ranks)
    return [(count[n], [order[r] for r in sorted(best.get(n.lower(), ()))[:most]]) for n in names]


def placed(names: Column, sentences: Column, weights: Column, most: int) -> Column:
    """struct(mentions, places) of each name as in mentioned(); null for null names."""

    @F.arrow_udf(PLACES)
    def found(names: pa.Array, sentences: pa.Array, weights: pa.Array) -> pa.Array:
        out = []
        for n, s, w in zip(names, sentences, weights):
            own = n.as_py()
            out.append(None if own is None else [{"mentions": m, "places": p} for m, p in mentioned(own, s.as_py(), w.as_py(), most)] if own else [])
        return pa.array(out, pa.list_(pa.struct([("mentions", pa.int32()), ("places", pa.list_(pa.int32()))])))

    return found(names, sentences, weights)
