"""Spelling variants: words one inserted, deleted or replaced letter apart, by rolling-hash deletions, and the form each goes back to.

1. counts(): runs of letters per slice of texts as arrays. A deterministic error model deletes a letter of some occurrences: those whose
   crc32 of `<doc_id>:<run>` a number divides; the crc of doc_id and run together follows from theirs by a table for each length, so
   occurrences are not hashed one by one. Words are pre-aggregated per slice and task before the shuffle, however hot.
2. deletions(): prefix and suffix polynomial hashes of a batch of words of one length give the keys of all their deletions as one matrix. A word
   sends a row for each place and one for itself, whole.
3. neighbours(): rows are dealt by radix (upper bits of the key) and sorted by key. A run of equal keys is a candidate group: its rows' strings are made and
   compared, so no collision counts. Words with one deletion at one place are a replacement apart; a whole word and those that give it by a deletion an
   insertion. A group gives each of its words a number of neighbours and the best one, never its pairs: linear in the group.
4. forms(), roots(): the near word that is often enough; chains to the last by pointer doubling, each round written.

A word of n letters sends n + 1 rows with its string. Above `LONG` letters rows go without strings, only those with a partner get theirs by a join, so a very
long word costs rows of a few bytes each. A group is bounded by the alphabet times the length, not by the data.

words() to roots() are jobs at once.

Defined cases: null or empty text: no words; null doc_id: its crc is that of `:<run>`; repeated rows: each counts; ties of n: the smaller in code-point order;
very long texts: a slice of their own; empty table: no rows; further columns are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, documents, partitions, tidy, written
from .resampling import CRC_TABLE_SQL, crc32_sql
from .spans import column, flat, runs
from .tokens import slices

DIVISOR, LEAST_LETTERS, LEAST_COUNT, RATIO = 97, 5, 3, 2
SLICE, LONG, BROADCAST_WORDS, GROUP_ROWS = 8 << 20, 64, 200_000, 50_000
U = np.uint64
#: Odd multipliers of the polynomial hashes and of the letters.
BASE, LETTER = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)
_ASCII = np.zeros(256, dtype=bool)
_ASCII[0x61:0x7B] = True
_C3 = 0xC3  # first byte of U+00C0 to U+00FF in UTF-8
_CRC = np.zeros(256, dtype=np.uint32)
for _i in range(256):
    _c = _i
    for _ in range(8):
        _c = (_c >> 1) ^ (0xEDB88320 if _c & 1 else 0)
    _CRC[_i] = _c


class Combiner:
    """crc32 of a + b from those of a and b: crc(a) advanced over as many zero bytes as b has, by four tables for each length."""

    MOST = 256

    def __init__(self):
        step = np.array([1 << i for i in range(32)], dtype=np.uint32)  # the identity, bit by bit
        self.tables = np.zeros((self.MOST, 4, 256), dtype=np.uint32)
        for length in range(self.MOST):
            for k in range(4):
                bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
                self.tables[length, k] = np.bitwise_xor.reduce(np.where(bits, step[8 * k : 8 * k + 8], 0).astype(np.uint32), axis=1)
            step = (step >> np.uint32(8)) ^ _CRC[step & np.uint32(0xFF)]

    def __call__(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """length: bytes of b, below MOST."""
        out = b.copy()
        for k in range(4):
            out ^= self.tables[length, k, (a >> np.uint32(8 * k)) & np.uint32(0xFF)]
        return out


_combiners: list[Combiner] = []


def combiner() -> Combiner:
    if not _combiners:
        _combiners.append(Combiner())
    return _combiners[0]


def letters(data: np.ndarray) -> np.ndarray:
    """Bytes of `[a-z\\u00C0-\\u00FF]` (A-Z are lowered): in UTF-8 the latter are C3 and the byte behind it."""
    lead = data == _C3
    member = _ASCII[data] | lead
    member[1:] |= lead[:-1]
    return member


def slice_counts(data: np.ndarray, offsets: np.ndarray, ids: list, divisor: int) -> tuple[list[bytes], np.ndarray]:
    """Lowered texts and their doc_ids -> (words, counts) after the deletions."""
    member = letters(data)
    starts, ends = runs(member, offsets)
    coded = column(data, member, starts, ends).dictionary_encode()
    codes, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    prefix = np.fromiter((zlib.crc32(b"%d:" % i if i is not None else b":") for i in ids), dtype=np.uint32, count=len(ids))
    text = np.repeat(np.arange(len(ids)), np.diff(np.searchsorted(starts, offsets)))
    crcs = np.fromiter(map(zlib.crc32, names), dtype=np.uint32, count=len(names))
    sizes = np.fromiter(map(len, names), dtype=np.int64, count=len(names))
    own_size = sizes[codes]
    found = combiner()(prefix[text], crcs[codes], np.minimum(own_size, Combiner.MOST - 1))
    for i in np.flatnonzero(own_size >= Combiner.MOST).tolist():
        found[i] = zlib.crc32(names[codes[i]], int(prefix[text[i]]))
    hit = np.flatnonzero(found % np.uint32(divisor) == 0)
    counts = np.bincount(codes, minlength=len(names)) - np.bincount(codes[hit], minlength=len(names))
    more: dict[bytes, int] = defaultdict(int)
    for i in hit.tolist():
        word = names[codes[i]].decode()
        at = int(found[i]) % len(word)
        more[(word[:at] + word[at + 1 :]).encode()] += 1
    return names + list(more), np.concatenate([counts, np.fromiter(more.values(), dtype=np.int64, count=len(more))])


def counts(docs: DataFrame, divisor: int = DIVISOR, least: int = LEAST_LETTERS) -> DataFrame:
    """docs(doc_id, text) -> (word, n) of `least` letters or more."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, size=SLICE):
                names, n = slice_counts(*flat(some.column("text")), some.column("doc_id").to_pylist(), divisor)
                words, n = pa.array(names, pa.binary()).cast(pa.string()), pa.array(n)
                good = pc.and_(pc.greater_equal(pc.utf8_length(words), least), pc.greater(n, 0))
                yield pa.RecordBatch.from_arrays([words.filter(good), n.filter(good)], names=["word", "n"])
        tidy()

    return docs.select("doc_id", "text").mapInArrow(task, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def deletion_keys(grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of one length as rows of code points -> (hash of each word, hash of each with the letter at each place deleted)."""
    n, length = grid.shape
    values = (grid.astype(np.uint64) + U(1)) * LETTER
    values ^= values >> U(29)
    prefix, suffix = np.zeros((n, length + 1), dtype=np.uint64), np.zeros((n, length + 1), dtype=np.uint64)
    power = np.ones(length + 1, dtype=np.uint64)
    for i in range(length):
        prefix[:, i + 1] = prefix[:, i] * BASE + values[:, i]
        power[i + 1 :] *= BASE
    for i in range(length - 1, -1, -1):
        suffix[:, i] = values[:, i] * power[length - 1 - i] + suffix[:, i + 1]
    deleted = prefix[:, :-1] * power[length - 1 :: -1][None, :length] + suffix[:, 1:]
    return _final(prefix[:, -1], length), _final(deleted, length - 1)


def _final(keys: np.ndarray, length: int) -> np.ndarray:
    keys = (keys ^ U(length)) * U(0xD6E8FEB86659FD93)
    return keys ^ (keys >> U(32))


def deletions(words: DataFrame) -> DataFrame:
    """words(word, n) -> key, place (-1: the whole word), letters (of what the key stands for), wid, word (null for long keys), n."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.utf8_length(batch.column("word")).to_numpy()
            order = np.argsort(sizes, kind="stable")
            at = 0
            while at < len(order):
                size = int(sizes[order[at]])
                to = min(int(np.searchsorted(sizes[order], size, side="right")), at + max(1, GROUP_ROWS // (size + 1)))
                own = batch.column("word").take(pa.array(order[at:to]))
                points = np.frombuffer("".join(own.to_pylist()).encode("utf-32-le"), dtype="<u4").reshape(to - at, size)
                whole, parts = deletion_keys(points)
                for keys, places, left in ((whole[:, None], np.array([-1]), size), (parts, np.arange(size), size - 1)):
                    which = np.repeat(np.arange(to - at), keys.shape[1])
                    rows = pa.array(order[at:to][which])
                    shown = batch.column("word").take(rows) if left < LONG else pa.nulls(len(which), pa.string())
                    columns = [pa.array(keys.ravel().view(np.int64)), pa.array(np.tile(places, to - at).astype(np.int32)), pa.array(np.full(len(which), left, dtype=np.int32)), batch.column("wid").take(rows), shown, batch.column("n").take(rows)]
                    yield pa.RecordBatch.from_arrays(columns, names=["key", "place", "letters", "wid", "word", "n"])
                at = to
        tidy()

    return words.select("word", F.xxhash64("word").alias("wid"), "n").mapInArrow(task, "key long, place int, letters int, wid long, word string, n long")


def by_radix(rows: DataFrame) -> DataFrame:
    """Rows dealt by the upper 16 bits of their key, sorted by key in each task."""
    return rows.repartition(partitions(rows.sparkSession), F.shiftrightunsigned("key", 48)).sortWithinPartitions("key")


def key_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted rows as tables that end where a key ends, without the keys that have one row."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column("key").to_numpy()
        last = int(np.searchsorted(keys, keys[-1], side="left"))
        if last == 0 and (not rest or rest[-1].column("key")[-1].as_py() == keys[0]):
            rest.append(batch)
            continue
        yield _shared(pa.Table.from_batches([*rest, batch.slice(0, last)]))
        rest = [batch.slice(last)]
    if rest:
        yield _shared(pa.Table.from_batches(rest))


def _shared(table: pa.Table) -> pa.Table:
    keys = table.column("key").to_numpy()
    same = np.zeros(len(keys) + 1, dtype=bool)
    same[1:-1] = keys[1:] == keys[:-1]
    return table.filter(pa.array(same[1:] | same[:-1]))


def group_neighbours(rows: list[tuple[int, str, int]]) -> Iterator[tuple[str, int, int, str]]:
    """(place, word, n) of one key -> (word, near words in this group, n and string of the best)."""
    by_string = defaultdict(list)
    for place, word, n in rows:
        by_string[word if place < 0 else word[:place] + word[place + 1 :]].append((place, -n, word))
    for string, members in by_string.items():
        replaced = defaultdict(list)
        longer, whole = {}, None
        for place, less, word in members:
            if place < 0:
                whole = (less, word)
            else:
                replaced[place].append((less, word))
                longer[word] = less
        for own in replaced.values():
            if len(own) > 1:
                first, second = sorted(own)[:2]
                for one in own:
                    best = second if one == first else first
                    yield one[1], len(own) - 1, -best[0], best[1]
        if whole and longer:
            best = min((less, word) for word, less in longer.items())
            yield string, len(longer), -best[0], best[1]
            for word in longer:
                yield word, 1, -whole[0], string


def neighbours(words: DataFrame) -> DataFrame:
    """words(word, n) -> word, n_near, best, best_n: words with a near one."""
    rows = deletions(words)

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in key_runs(batches):
            keys = table.column("key").to_numpy()
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            places, names, n = (table.column(c).to_pylist() for c in ("place", "word", "n"))
            found = [x for a, b in zip(cuts, cuts[1:]) if len({*names[a:b]}) > 1 for x in group_neighbours(list(zip(places[a:b], names[a:b], n[a:b])))]
            columns = zip(*found) if found else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["word", "near", "best_n", "best"])
        tidy()

    def partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in key_runs(batches):
            yield from table.select(["key", "place", "wid", "n"]).to_batches()

    schema = "word string, near long, best_n long, best string"
    found = by_radix(rows.where(F.col("letters") < LONG).select("key", "place", "word", "n")).mapInArrow(verified, schema)
    if not words.where(F.length("word") >= LONG).isEmpty():
        lengthy = by_radix(rows.where(F.col("letters") >= LONG).select("key", "place", "wid", "n")).mapInArrow(partners, "key long, place int, wid long, n long")
        several = lengthy.groupBy("key").agg(F.min("wid").alias("least"), F.max("wid").alias("most")).where("least < most").select("key")
        named = words.where(F.length("word") >= LONG).select(F.xxhash64("word").alias("wid"), "word")
        strings = lengthy.join(several, "key", "left_semi").join(named, "wid").select("key", "place", "word", "n")
        found = found.unionByName(by_radix(strings).mapInArrow(verified, schema))
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word"))).alias("b")
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best).select("word", "n_near", F.col("b.word").alias("best"), (-F.col("b.less")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """forms(word, form) -> (word, root): where the forms lead, by doubling; a form occurs more often than its word, so there are no circles."""
    links = written(forms.select("word", F.col("form").alias("root")))
    while True:
        after = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = written(links.join(after, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        discard(links)
        links = joined
        if links.where("moved").isEmpty():
            return links.select("word", "root")


def variants(docs: DataFrame, divisor: int = DIVISOR, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, ratio: int = RATIO) -> DataFrame:
    """docs(doc_id, text) -> word, n, n_near, form, form_n, root: every word often and long enough."""
    words = written(counts(docs, divisor, least_letters).where(F.col("n") >= least_count))
    near = neighbours(words)
    strong = F.col("best_n") >= ratio * F.col("n")
    rows = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(strong, F.col("best")).alias("form"), F.when(strong, F.col("best_n")).alias("form_n"))
    rows = written(rows)
    discard(words)
    return rows.join(roots(rows.where("form IS NOT NULL")), "word", "left").withColumn("root", F.coalesce("root", "word"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(documents(spark, sf_dir)).select("word", "form", "root", "n", "n_near", "form_n")


QUERIES = {"op13_spelling": op13_spelling}
ORACLES = {
    "op13_spelling": f"""
WITH RECURSIVE {CRC_TABLE_SQL},
runs AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
low AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM runs GROUP BY ALL),
keyed AS (SELECT run, n, doc_id || ':' || run AS k FROM low WHERE length(run) >= {LEAST_LETTERS}),
hashed AS (SELECT run, n, {crc32_sql("k")} AS h FROM keyed, crc),
cut AS (SELECT CASE WHEN h % {DIVISOR} = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= {LEAST_LETTERS} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
parts AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS part FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS i FROM words)),
pairs AS (SELECT a.word, b.word AS near, b.n FROM parts a JOIN parts b ON a.part = b.part AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM parts a JOIN words b ON a.part = b.word
  UNION SELECT b.word, a.word, a.n FROM parts a JOIN words b ON a.part = b.word),
best AS (SELECT word, near, n, row_number() OVER (PARTITION BY word ORDER BY n DESC, encode(near)) AS r, count(*) OVER (PARTITION BY word) AS n_near FROM pairs),
formed AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN b.n >= {RATIO} * w.n THEN near END AS form, CASE WHEN b.n >= {RATIO} * w.n THEN b.n END AS form_n FROM words w LEFT JOIN best b ON w.word = b.word AND r = 1),
chain AS (SELECT word, word AS root, form FROM formed UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN formed f ON c.form = f.word)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM formed f JOIN chain c ON f.word = c.word AND c.form IS NULL"""
}
