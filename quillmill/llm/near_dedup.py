"""Near-duplicate documents: a chosen-path set-similarity join over minhashes, links confirmed on full shingle sets.

1. A document's set is its distinct five-word shingles, as 48-bit hashes. Equal sets are one class from here on, so copies
   cost nothing further. A class has a signature of `COORDINATES` minwise tokens, read off its sorted hashes (the smallest hash
   of each range of the hash space; an empty range borrows another's).
2. In each of `TREES` independent trees a class walks down from the root: at every node it picks, by a hash that depends on the
   node and the token, about `width` of its tokens and goes on to a child for each. After `LEVELS` levels the nodes are small:
   classes that differ rarely meet, similar ones meet in some tree with a probability near one.
3. Nodes are compared exhaustively on signatures; nodes above `SMALL` branch further down first. What looks similar
   (`looks` of the tokens, about four standard deviations below the limit) forms clusters; a node above `NODE_BLOCK` classes, which
   branching has not thinned out, is one cluster as a whole.
4. In each cluster full sets confirm links, exactly; pairs already joined by confirmed links are skipped, so a group of copies
   costs about one comparison each and no group's pairs are ever emitted. A cluster above `BLOCK` classes is dealt to smaller blocks
   that share a few anchors, which joins most of a group of copies; the classes that are outside their cluster's main component
   then branch on by the rarest tokens of their full sets: those that meet in one of their first tokens (a positional prefix filter,
   exact for sets of any length) are confirmed on full sets. Many documents of one template that are no copies have their own
   tokens first, so they never meet, however many they are.
5. Signatures of sets below `COORDINATES` shingles scatter too widely: such classes also join clusters by the same prefixes
   and are compared on full sets alone.
6. Components of the confirmed links are the groups.

Everything up to the components is made by jobs at once, for each step's size decides how the next is dealt; the join of labels is lazy.

Defined cases: fewer than five words: one shingle of them all; no words or null text: empty set, linked with nothing; null doc_id:
takes part, but names a component only if all are null; repeated rows: same class; very long texts: as any other; empty table: no
rows; `deduplicate` carries further columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, documents, partitions, text_or_empty, tidy, written
from .components import components

#: PERCENT is the limit of op4, STAGE_PERCENT that of the pipeline's stage; all functions take either.
SHINGLE, PERCENT, STAGE_PERCENT = 5, 85, 80
COORDINATES, TREES, LEVELS, MEET, SMALL = 64, 12, 3, 1.2325, 256
#: Sets that a set below COORDINATES shingles can be linked with at 80 percent have no more than SHORT.
SHORT = 100 * (COORDINATES - 1) // 80
#: Hash buckets of shingles that are counted together, to order them by.
KINDS = 1 << 20
#: A cluster above BLOCK classes is dealt to blocks of BLOCK / PARTS.
BLOCK, PARTS, ANCHORS, NODE_BLOCK, BROADCAST_MEMBERS, BROADCAST_NODES = 1000, 4, 4, 20_000, 500_000, 100_000
U = np.uint64
MASK48 = U((1 << 48) - 1)
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def looks(percent: int) -> float:
    """Share of equal tokens from which classes look similar: 4.25 standard deviations below the limit."""
    return percent / 100 - 4.25 * (percent / 100 * (1 - percent / 100) / COORDINATES) ** 0.5


def width(percent: int) -> float:
    """Tokens picked at a node: classes at the limit share MEET of its children on average, whatever the limit."""
    return MEET * 100 / percent


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 48-bit hashes of the shingles of lowered words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = max(1, len(h) - SHINGLE + 1)
    total = np.full(n, len(h) if len(h) < SHINGLE else 0, dtype=np.uint64)
    for k in range(min(SHINGLE, len(h))):
        total = mix(total + h[k : k + n] * ODD[k])
    return np.unique(total & MASK48)


_EDGES = (np.arange(COORDINATES + 1, dtype=np.uint64) << U(48)) // U(COORDINATES)


def signature(hashes: np.ndarray) -> np.ndarray:
    """COORDINATES 16-bit tokens of a set that is not empty."""
    at = np.searchsorted(hashes, _EDGES)
    full = at[1:] > at[:-1]
    tokens = mix(hashes[np.minimum(at[:-1], len(hashes) - 1)])
    turn = 0
    while not full.all():  # an empty range borrows, by the same fixed order in every set
        turn += 1
        donor = mix(np.arange(COORDINATES, dtype=np.uint64) + U(turn * 1000)) % U(COORDINATES)
        donor = donor.astype(np.int64)
        borrowed = ~full & full[donor]
        tokens[borrowed] = mix(tokens[donor[borrowed]] + U(turn))
        full = full | borrowed
        if turn > 64:
            tokens[~full] = mix(tokens[full][0] + U(turn) + np.flatnonzero(~full).astype(np.uint64))
            break
    return (tokens & U(0xFFFF)).astype("<u2")


def pack(hashes: np.ndarray) -> bytes:
    return (hashes >> U(16)).astype("<u4").tobytes() + (hashes & U(0xFFFF)).astype("<u2").tobytes()


def unpack(raw: bytes) -> np.ndarray:
    n = len(raw) // 6
    return (np.frombuffer(raw, "<u4", n).astype(np.uint64) << U(16)) | np.frombuffer(raw, "<u2", n, 4 * n)


def text_key() -> Column:
    return F.xxhash64(text_or_empty())


def sets(docs: DataFrame, whole: bool = False) -> DataFrame:
    """docs(doc_id, text) -> doc_id, text_key, n_shingles, sid (class of equal sets; null if empty), sig, hashes.

    Hashes are kept for sets of up to `SHORT` shingles only, unless the whole ones are asked for: they are the bulk, and needed
    again for few documents, whose texts are then read once more.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                found = [shingles(t) for t in some.column("text").to_pylist()]
                raw = [pack(h) if len(h) else None for h in found]
                kept = [r if r and (whole or len(h) <= SHORT) else None for r, h in zip(raw, found)]
                columns = [some.column("doc_id").cast(pa.int64()), some.column("text_key"), pa.array([len(h) for h in found], pa.int64()), pa.array([r and xxhash.xxh3_64_intdigest(r) - (1 << 63) for r in raw], pa.int64()), pa.array([signature(h).tobytes() if len(h) else None for h in found], pa.binary()), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "n_shingles", "sid", "sig", "hashes"])
        tidy()

    return docs.select("doc_id", text_key().alias("text_key"), "text").mapInArrow(task, "doc_id long, text_key long, n_shingles long, sid long, sig binary, hashes binary")


def branch(paths: np.ndarray, owner: np.ndarray, tokens: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """One level down: for every (path, row of tokens) the children it picks, as (path, owner)."""
    limit = U(int(width(percent) / COORDINATES * 2**64))
    out_path, out_owner = [], []
    for at in range(0, len(paths), 4096):
        p, o = paths[at : at + 4096], owner[at : at + 4096]
        child = mix(p[:, None] ^ tokens[o])
        row, col = np.nonzero(child < limit)
        out_path.append(mix(child[row, col] + U(1)))
        out_owner.append(o[row])
    return (np.concatenate(out_path), np.concatenate(out_owner)) if out_path else (paths, owner)


def _tokens(sigs: np.ndarray) -> np.ndarray:
    """Signature rows -> 64-bit tokens that name coordinate and value."""
    return mix(sigs.astype(np.uint64) + (np.arange(COORDINATES, dtype=np.uint64) << U(16)))


def nodes(classes: DataFrame, percent: int) -> DataFrame:
    """classes(sid, sig) -> (node, sid) after LEVELS levels of every tree."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                tokens = _tokens(np.frombuffer(b"".join(batch.column("sig").to_pylist()), "<u2").reshape(-1, COORDINATES))
                for tree in range(TREES):
                    owner = np.arange(batch.num_rows)
                    paths = np.full(batch.num_rows, mix(np.array([tree + 1], dtype=np.uint64))[0])
                    for _ in range(LEVELS):
                        paths, owner = branch(paths, owner, tokens, percent)
                    yield pa.RecordBatch.from_arrays([pa.array(paths.view(np.int64)), batch.column("sid").take(pa.array(owner))], names=["node", "sid"])

    return classes.select("sid", "sig").mapInArrow(task, "node long, sid long")


def shared_nodes(rows: DataFrame, block: int) -> DataFrame:
    """(node, part, sid) of nodes with two classes or more; part: whole blocks of classes before it in the node.

    Rows arrive sorted by node and pass through, so memory does not follow a node's size.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, first, n, last = None, None, 0, None
        for batch in batches:
            out = ([], [], [])
            for k, sid in zip(batch.column("node").to_pylist(), batch.column("sid").to_pylist()):
                if k != node:
                    node, first, n, last = k, sid, 1, sid
                elif sid != last:
                    last = sid
                    if n == 1:
                        for column, v in zip(out, (node, 0, first)):
                            column.append(v)
                    for column, v in zip(out, (node, n // block, sid)):
                        column.append(v)
                    n += 1
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], names=["node", "part", "sid"])
        tidy()

    dealt = rows.repartition(partitions(rows.sparkSession), "node").sortWithinPartitions("node", "sid")
    return dealt.mapInArrow(task, "node long, part long, sid long")


def _resemble(a: pa.Array, b: pa.Array, percent: int) -> np.ndarray:
    x, y = (np.frombuffer(b"".join(c.to_pylist()), "<u2").reshape(-1, COORDINATES) for c in (a, b))
    return (x == y).sum(1) >= looks(percent) * COORDINATES


def large_nodes(members: DataFrame, percent: int, few: bool = True) -> DataFrame:
    """members(node, sid, sig) of nodes above NODE_BLOCK -> (a, b): all classes of a node are joined, to its first. few: the nodes, a row each, may be broadcast."""
    firsts = members.groupBy("node").agg(F.min("sid").alias("a"))
    return members.join(F.broadcast(firsts) if few else firsts, "node").where("sid <> a").select("a", F.col("sid").alias("b"))


def alike(sigs: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs that join the rows into the components of looking similar."""
    n = len(sigs)
    label = np.arange(n)
    joins = []
    for i in range(n - 1):
        rest = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        if len(rest):
            near = rest[(sigs[rest] == sigs[i]).sum(1) >= looks(percent) * COORDINATES]
            for j in near:
                if label[j] != label[i]:
                    joins.append((i, int(j)))
                    label[label == label[j]] = label[i]
    return joins


def candidates(members: DataFrame, percent: int) -> DataFrame:
    """(node, sid, sig) -> (a, b): classes that look similar, a spanning set per node."""

    def compare(ids: np.ndarray, sigs: np.ndarray, depth: int, path: int) -> set[tuple[int, int]]:
        if len(ids) > SMALL and depth < 3:
            start = np.full(len(ids), mix(np.array([path + depth], dtype=np.uint64))[0])
            paths, owner = start, np.arange(len(ids))
            found: set[tuple[int, int]] = set()
            for _ in range(2):
                paths, owner = branch(paths, owner, _tokens(sigs), percent)
            order = np.argsort(paths, kind="stable")
            for own in np.split(owner[order], np.flatnonzero(np.diff(paths[order])) + 1):
                own = np.unique(own)
                if len(own) > 1:
                    found |= compare(ids[own], sigs[own], depth + 1 if len(own) < len(ids) else 3, path + 1)
            # a node of copies does not thin out: everything also meets the first class
            near = np.flatnonzero((sigs == sigs[0]).sum(1) >= looks(percent) * COORDINATES)
            return found | {(int(ids[0]), int(ids[j])) for j in near if j}
        return {(int(ids[i]), int(ids[j])) for i, j in alike(sigs, percent)}

    def node(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("sid")
        sigs = np.frombuffer(b"".join(frame["sig"]), "<u2").reshape(-1, COORDINATES)
        return pd.DataFrame(sorted(compare(frame["sid"].to_numpy(), sigs, 0, 1)), columns=["a", "b"]).astype("int64")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(table: pd.DataFrame) -> pa.RecordBatch:
            parts = [node(f) for _, f in table.groupby("node", sort=False) if len(f) > 1]
            edges = pd.concat(parts).drop_duplicates() if parts else pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
            return pa.RecordBatch.from_pandas(edges, preserve_index=False)

        rest = None
        for batch in batches:
            frame = batch.to_pandas()
            frame = frame if rest is None else pd.concat([rest, frame])
            if not len(frame):
                continue
            last = frame["node"] == frame["node"].iloc[-1]
            rest = frame[last]
            if not last.all():
                yield flush(frame[~last])
        if rest is not None:
            yield flush(rest)
        tidy()

    dealt = members.select("node", "sid", "sig").repartition(partitions(members.sparkSession), "node").sortWithinPartitions("node", "sid")
    return dealt.mapInArrow(task, "a long, b long").distinct()


def commonness(table: DataFrame) -> np.ndarray:
    """How common shingles are: the logarithm of the number of sets in (hashes) that hold one of each of KINDS hash buckets; a byte for each, whatever the table's size."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(KINDS, dtype=np.int64)
        for batch in batches:
            for raw in batch.column("hashes").to_pylist():
                total[kind(unpack(raw))] += 1
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["kind", "n"])
        tidy()

    found = table.select("hashes").mapInArrow(task, "kind long, n long").groupBy("kind").agg(F.sum("n").alias("n"))
    rows = found.select(F.col("kind").cast("int"), F.ceil(F.log2("n")).cast("byte").alias("level")).toArrow()  # KINDS rows at most
    levels = np.zeros(KINDS, dtype=np.uint8)
    levels[rows.column("kind").to_numpy()] = rows.column("level").to_numpy()
    return levels


def kind(hashes: np.ndarray) -> np.ndarray:
    return (mix(hashes) % U(KINDS)).astype(np.int64)


def prefixes(table: DataFrame, percent: int) -> DataFrame:
    """(sid, hashes) -> (sid, n, token, place): the first n - ceil(limit * n) + 1 of each set's n shingles, the rarest first, places from 1.

    Two sets that reach the limit share one of these, in any order that is the same for all sets: here by commonness(), then by hash.
    """
    levels = commonness(table)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                sizes, firsts = [], []
                for raw in some.column("hashes").to_pylist():
                    own = unpack(raw)
                    sizes.append(len(own))
                    firsts.append(own[np.argsort(levels[kind(own)], kind="stable")[: len(own) - -(-len(own) * percent // 100) + 1]])
                held = np.array([len(x) for x in firsts], dtype=np.int64)
                places = np.arange(held.sum()) - np.repeat(np.cumsum(held) - held, held) + 1
                columns = [some.column("sid").take(pa.array(np.repeat(np.arange(len(held)), held))), pa.array(np.repeat(np.array(sizes, dtype=np.int64), held)), pa.array(np.concatenate([np.zeros(0, dtype=np.uint64), *firsts]).astype(np.int64)), pa.array(places)]
                yield pa.RecordBatch.from_arrays(columns, names=["sid", "n", "token", "place"])
        tidy()

    return table.select("sid", "hashes").mapInArrow(task, "sid long, n long, token long, place long")


def prefix_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """prefixes() rows with root and outside -> (a, b): pairs of different roots, one of them outside at least, that may reach the limit; none that does is missed.

    The smaller set of a pair is asked for fewer tokens, for its partner is no smaller; and what stands behind a shared token must
    be enough for the shingles that the pair needs in common.
    """
    needed = lambda n: F.ceil(n * percent / (100.0 + percent) - 1e-9)
    of = lambda df, x: df.select(F.col("token"), *[F.col(c).alias(f"{x}_{c}") for c in ("sid", "n", "place", "root", "outside")])
    index = rows.where(F.col("place") <= F.col("n") - needed(F.col("n") * 2) + 1)
    order = (F.col("a_n") > F.col("b_n")) | ((F.col("a_n") == F.col("b_n")) & (F.col("a_sid") > F.col("b_sid")))
    enough = 1 + F.least(F.col("a_n") - F.col("a_place"), F.col("b_n") - F.col("b_place")) >= needed(F.col("a_n") + F.col("b_n"))
    fits = order & (F.col("a_root") != F.col("b_root")) & (F.col("b_n") * 100 >= F.col("a_n") * percent) & enough
    met = lambda a, b: of(a, "a").join(of(b, "b"), "token").where(fits).select(F.col("a_sid").alias("a"), F.col("b_sid").alias("b"))
    return met(rows.where("outside"), index).unionByName(met(rows.where("NOT outside"), index.where("outside"))).distinct()


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets (sid, hashes) reach the limit."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [similar(unpack(x), unpack(y), percent) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))
        tidy()

    one, other = sets.select(F.col("sid").alias("a"), F.col("hashes").alias("x")), sets.select(F.col("sid").alias("b"), F.col("hashes").alias("y"))
    return pairs.join(one, "a").join(other, "b").select("a", "b", "x", "y").mapInArrow(task, "a long, b long")


def short_edges(table: DataFrame, percent: int) -> DataFrame:
    """(a, b): classes that share a shingle of their prefixes, to the least of each shingle's; no pair with a set below COORDINATES is missed."""
    least = 100 * (COORDINATES - 1) // percent
    assert least <= SHORT, "hashes of longer sets are not kept"
    prefix = written(prefixes(table.where(F.col("sid").isNotNull() & (F.col("n_shingles") <= least)), percent).select("sid", "token").distinct())
    firsts = prefix.groupBy("token").agg(F.min("sid").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    edges = written(prefix.join(firsts, "token").where("sid <> a").select("a", F.col("sid").alias("b")).distinct())
    discard(prefix)
    return edges


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * shared >= percent * united, on sorted hashes."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    shared = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def confirm(ids: list[int], hashes: list[np.ndarray], sigs: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Confirmed links that join the rows into their exact components."""
    n = len(ids)
    label, size, links = np.arange(n), np.array([len(h) for h in hashes]), []
    for i in range(n - 1):
        rest = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        rest = rest[(100 * np.minimum(size[rest], size[i]) >= percent * np.maximum(size[rest], size[i]))]
        if len(rest):  # signatures of short sets scatter too widely to judge by
            short = np.minimum(size[rest], size[i]) < COORDINATES
            rest = rest[short | ((sigs[rest] == sigs[i]).sum(1) >= (looks(percent) - 0.06) * COORDINATES)]
        for j in rest:
            if label[j] != label[i] and similar(hashes[i], hashes[j], percent):
                links.append((ids[i], ids[j]))
                label[label == label[j]] = label[i]
    return links


def confirmed(members: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """members(keys, sid, sig, hashes) -> (a, b), group by group; groups are bounded by BLOCK."""

    def group(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates("sid").sort_values("sid")
        sigs = np.frombuffer(b"".join(frame["sig"]), "<u2").reshape(-1, COORDINATES)
        links = confirm(frame["sid"].tolist(), [unpack(h) for h in frame["hashes"]], sigs, percent)
        return pd.DataFrame(links, columns=["a", "b"]).astype("int64")

    return members.groupBy(*keys).applyInPandas(group, "a long, b long")


def links(table: DataFrame, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """sets() rows, and the documents they are of -> confirmed links (a, b) between classes that join each component."""
    classes = table.where("sid IS NOT NULL").groupBy("sid").agg(F.first("sig").alias("sig"), F.min(F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("least"))
    classes = written(classes)
    met = written(shared_nodes(nodes(classes, percent), NODE_BLOCK))
    sigs = classes.select("sid", "sig")
    large = met.where("part > 0").select("node").distinct()  # at most one in NODE_BLOCK rows of met
    n_large = large.count()
    few = n_large <= BROADCAST_NODES
    if not n_large:
        edges = candidates(met.join(sigs, "sid"), percent)
    else:
        large = F.broadcast(large) if few else large
        edges = candidates(met.join(large, "node", "left_anti").join(sigs, "sid"), percent)
        edges = edges.unionByName(large_nodes(met.join(large, "node", "left_semi").join(sigs, "sid"), percent, few))
    edges = written(edges.unionByName(short_edges(table, percent)).distinct())
    discard(met)
    clusters = written(components(edges).select(F.col("node").alias("sid"), F.col("root").alias("cluster")))
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("blocks", F.when(F.col("n") > BLOCK, F.ceil(F.col("n") * PARTS / BLOCK)).otherwise(1).cast("int"))
    placed = clusters.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))

    wanted = placed.join(classes.select("sid", "least"), "sid").select("sid", F.col("least").alias("doc_key"), "cluster", "block", "blocks")
    n_wanted = clusters.count()
    wanted = F.broadcast(wanted) if n_wanted <= BROADCAST_MEMBERS else wanted
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    asked = docs.select("doc_id", "text").withColumn("doc_key", key).join(wanted.select("doc_key").distinct() if n_wanted > BROADCAST_MEMBERS else F.broadcast(wanted.select("doc_key").distinct()), "doc_key", "left_semi")
    full = sets(asked, whole=True).where("sid IS NOT NULL").select("sid", key.alias("doc_key"), "sig", "hashes")
    members = written(full.join(wanted, ["sid", "doc_key"]).dropDuplicates(["sid"]))
    for table in (edges, classes, clusters):
        discard(table)

    large = members.where("blocks > 1")
    anchors = large.where(F.pmod(F.xxhash64("sid", F.lit(1)), F.lit(BLOCK)) < ANCHORS)  # about ANCHORS to a block's worth, spread over all blocks below
    shared = anchors.withColumn("turn", F.pmod(F.xxhash64("sid", F.lit(2)), F.col("blocks"))).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    shared = shared.where(F.col("turn") < ANCHORS).drop("turn")
    found = written(confirmed(members.unionByName(shared), ["cluster", "block"], percent))
    if large.isEmpty():
        discard(members)
        return found
    # classes outside their cluster's main component meet the others by prefixes of their full sets
    roots = components(found)
    labelled = large.select("sid", "cluster").join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    labelled = written(labelled)
    counts = labelled.groupBy("cluster", "root").count()
    main = counts.groupBy("cluster").agg(F.max_by("root", F.struct("count", "root")).alias("main"))
    placed = labelled.join(main, "cluster").select("sid", "root", (F.col("root") != F.col("main")).alias("outside"))
    if placed.where("outside").isEmpty():
        discard(labelled)
        discard(members)
        return found
    prefix = written(prefixes(large, percent).join(placed, "sid"))
    more = written(verified(prefix_pairs(prefix, percent), large.select("sid", "hashes"), percent))
    for table in (prefix, labelled, members):
        discard(table)
    return found.unionByName(more)


def groups(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs(doc_id, text) -> doc_id, text_key, n_shingles, component_id, kept, sid, root: one row per document."""
    return grouped(written(sets(docs)), docs, percent)


def grouped(table: DataFrame, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The same from a written sets() table of the documents."""
    classes = table.where("sid IS NOT NULL").groupBy("sid").agg(F.min("doc_id").alias("least"))
    roots = components(links(table, docs, percent)).withColumnRenamed("node", "sid")
    own = classes.join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    named = own.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = own.select("sid", "root").join(named, "root").select("sid", "root", "component_id")
    rows = table.select("doc_id", "text_key", "n_shingles", "sid").join(labels, "sid", "left")
    rows = rows.withColumn("component_id", F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def deduplicate(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each group: the smallest doc_id's, a null one's only if all are null (rows without words all stay).

    A row is known by doc_id and text; of a surviving row that is repeated one stays. Which rows stay is written, and the sets, the bulk of what this leaves in the shared folder, are removed at once.
    """
    table = written(sets(docs))
    marks = grouped(table, docs, percent)
    rows = marks.where("sid IS NOT NULL").groupBy("root", "doc_id", "text_key").agg(F.count("*").alias("times"))
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("text_key"), F.col("times"))
    named = rows.groupBy("root").agg(F.min(first).alias("s")).select(F.col("s.doc_id").alias("_stay_id"), F.col("s.text_key").alias("_stay_key"), F.col("s.times").alias("_times"))
    wordless = marks.where("sid IS NULL").select(F.col("doc_id").alias("_stay_id"), F.col("text_key").alias("_stay_key"), F.lit(1).cast("long").alias("_times")).distinct()
    stays = written(named.unionByName(wordless))
    discard(table)
    found = docs.withColumn("_key", text_key()).join(stays, F.col("doc_id").eqNullSafe(F.col("_stay_id")) & (F.col("_key") == F.col("_stay_key")))
    once = found.where("_times = 1")
    if not stays.where("_times > 1").isEmpty():
        once = once.unionByName(found.where("_times > 1").dropDuplicates(["doc_id", "_key"]))
    return once.select(*docs.columns)


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "kept")


QUERIES = {"op4_near_dedup": op4_near_dedup}
ORACLES: dict[str, str] = {}
