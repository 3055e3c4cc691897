"""Exact duplicates, resampling and spelling variants against brute force and DuckDB, with nulls, long texts, ties, repeated rows and clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmill.llm import exact_dedup, resampling, spans, spelling

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"
LONG = " ".join(f"Wörd{i % 977}x{i % 13}" for i in range(40_000))
TEXTS = [None, "", "", " ", "Same TEXT here", "same text here", "same text HERE", "ÄB é 中文 \x00 x", "äB é 中文 \x00 x", LONG, LONG.upper(), LONG, "a" * 300, "one two three"]


def lower(text):
    return (text or "").translate(str.maketrans(exact_dedup.UPPER, exact_dedup.LOWER))


def rows(texts=TEXTS):
    return [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)] + [(4, "Same TEXT here", "en", "s", 14), (None, "Same text HERE", "en", "s", 14), (None, "alone without an id", "en", "s", 3), (None, "twice without an id", "en", "s", 3), (None, "TWICE without an id", "en", "s", 3)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


# --- exact duplicates -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 7, 1000])
@pytest.mark.parametrize("space", [1 << 11, 1 << 40])
def test_golomb_codes_round_trip(n, space):
    values = np.unique(np.random.default_rng(n).integers(0, space, n).astype(np.uint64))
    for shift in (0, exact_dedup.golomb_shift(len(values), space)):
        if shift or space < 1 << 20:
            code = exact_dedup.golomb_encode(values, shift)
            assert exact_dedup.golomb_decode(code, len(values), shift).tolist() == values.tolist()
    if n == 1000 and space > 1 << 20:  # near the entropy of a random set
        assert len(code) * 8 <= len(values) * (math.log2(space / len(values)) + 2.2)


def plain_labels(table):
    groups = defaultdict(list)
    for i, t, *_ in table:
        groups[lower(t)].append(i)
    best = {k: max((i for i in ids if i is not None), default=None) for k, ids in groups.items()}
    return sorted(((i, best[lower(t)], len(groups[lower(t)]), i == best[lower(t)], hashlib.sha256(lower(t).encode()).hexdigest()) for i, t, *_ in table), key=repr)


@pytest.mark.parametrize("slack", [10, 0])
def test_labels_equal_brute_force(docs, slack):
    """Without slack many texts share a fingerprint by chance: the bytes tell them apart."""
    assert sorted(map(tuple, exact_dedup.labels(docs, slack).collect()), key=repr) == plain_labels(rows())


def test_packets_of_many_senders_and_owners(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SENDER_ROWS", 50)
    monkeypatch.setattr(exact_dedup, "OWNER_ROWS", 40)
    monkeypatch.setattr(exact_dedup, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", 0)
    table = [(i, f"Text {'third' if i % 3 == 0 else i // 4}") for i in range(1000)]
    found = exact_dedup.labels(spark.createDataFrame(table, "doc_id long, text string").repartition(4))
    assert sorted(map(tuple, found.collect()), key=repr) == plain_labels(table)


def test_one_row_of_each_class_stays(spark, docs):
    got = exact_dedup.deduplicate(docs.withColumnsRenamed({"source": "sha", "n_chars": "fingerprint"}).withColumn("mark", F.lit(1)).withColumn("part", F.lit(2)))
    kept = Counter((r.doc_id, r.text) for r in got.collect())
    want = {lower(t): i for _, i, t in sorted((-1 if i is None else i, i, t) for i, t, *_ in [(i, t or "") for i, t, *_ in rows()])}
    assert {(lower(t), i) for i, t in kept} == set(want.items()) and max(kept.values()) == 1
    none = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.deduplicate(none).count() == 0 and exact_dedup.labels(none).count() == 0


# --- resampling -----------------------------------------------------------------------------------------------------------


def plain_features(text, low=1, high=1, buckets=10_000):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text).encode())
    return [zlib.crc32(b" ".join(words[i : i + n])) % buckets for n in range(low, high + 1) for i in range(len(words) - n + 1)], len(words)


@pytest.mark.parametrize("low,high,buckets", [(1, 1, 10_000), (1, 3, 70_000), (2, 5, 1000)])
def test_features_equal_brute_force(docs, low, high, buckets):
    got = {(r.doc_id, r.text_key): (np.frombuffer(r.features, "<u2" if buckets <= 1 << 16 else "<u4").tolist(), r.n_words, r.n_features) for r in resampling.features(docs, low, high, buckets).collect()}
    for r in docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("k")).collect():
        values, n_words = plain_features(r.text, low, high, buckets)
        assert got[r.doc_id, r.k] == (values, n_words, len(values))


def test_suffixes_are_sorted_and_their_shared_words_counted():
    r = np.random.default_rng(1)
    codes, sizes = r.integers(0, 3, 400).astype(np.int32), [1, 120, 0, 79, 200]
    left = np.concatenate([np.arange(n, 0, -1) for n in sizes if n])
    for depth in (1, 2, 5, 8):
        order, shared = resampling.suffixes(codes, left, depth)
        text = [tuple(codes[p : p + min(depth, left[p])]) for p in range(400)]
        assert [text[p] for p in order] == sorted(text)
        common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert shared.tolist() == [0] + [common(text[a], text[b]) for a, b in zip(order, order[1:])]


def plain_draw(table, target, percent, least):
    docs, aim = [(i, *plain_features(t)) for i, t in table], Counter(x for t in target for x in plain_features(t)[0])
    corpus = Counter(x for _, f, _ in docs for x in f)
    S, T = sum(corpus.values()), sum(aim.values())
    gain = lambda b: math.floor(1000 * math.log((aim[b] + 1) * (S + 10_000) / ((corpus[b] + 1) * (T + 10_000))))
    out = []
    for i, f, n in docs:
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    return out, able[: percent * len(able) // 100]


def test_draw_equals_brute_force(spark):
    r = np.random.default_rng(3)
    table = [(int(i), None if i % 50 == 0 else " ".join(f"W{x}" for x in r.zipf(1.3, int(r.integers(1, 60))) % 500)) for i in range(600)]
    target = [" ".join(f"w{x}" for x in r.integers(0, 40, 50)) for _ in range(20)] + [None]
    docs, aim = spark.createDataFrame(table, "doc_id long, text string").repartition(4), spark.createDataFrame([(t,) for t in target], "text string")
    want, drawn = plain_draw(table, target, 10, 20)
    got = resampling.ranked(resampling.scored(docs, aim)).collect()
    assert sorted((x.doc_id, x.n_features, x.weight, x.score) for x in got) == sorted(tuple(x[:4]) for x in want)
    assert [x.doc_id for x in sorted((x for x in got if x["rank"]), key=lambda x: x["rank"])] == [x[0] for x in drawn] and len(drawn) > 20
    wide = docs.withColumns({c: F.lit(1) for c in ("rank", "score", "text_key", "features", "n_words")})
    assert {x.doc_id for x in resampling.drawn(wide, aim).collect()} == {x[0] for x in drawn} and resampling.drawn(wide, aim).columns == wide.columns


def test_draw_of_ties_nulls_and_nothing(spark, docs):
    same = spark.createDataFrame([(7, "w " * 30)] * 50 + [(None, "w " * 30)] * 10, "doc_id long, text string")
    aim = spark.createDataFrame([], "text string")
    got = [x["rank"] for x in resampling.ranked(resampling.scored(same, aim)).collect()]
    assert sorted(x for x in got if x) == [1, 2, 3, 4, 5, 6] and len(got) == 60
    assert resampling.ranked(resampling.scored(docs, aim)).where("n_words < 20 AND rank IS NOT NULL").count() == 0
    assert resampling.ranked(resampling.scored(spark.createDataFrame([], SCHEMA), aim)).count() == 0


# --- spelling variants ----------------------------------------------------------------------------------------------------


def plain_words(table, divisor=97, least=5, often=3):
    n = Counter()
    for i, t in table:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % divisor == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= least and c >= often}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(table, **settings):
    words = plain_words(table, **settings)
    found = {}
    for w, n in words.items():
        others = [x for x in words if abs(len(x) - len(w)) <= 1 and near(w, x)]
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form = best if best and words[best] >= 2 * n else None
        found[w] = (n, len(others), form, words[form] if form else None)
    def root(w):
        return root(found[w][2]) if found[w][2] else w
    return sorted(((w, *v, root(w)) for w, v in found.items()), key=repr)


def spelled(frame, **settings):
    return sorted(map(tuple, spelling.variants(frame, **settings).select("word", "n", "n_near", "form", "form_n", "root").collect()), key=repr)


def test_variants_equal_brute_force(spark):
    r = np.random.default_rng(5)
    stems = ["".join(r.choice(list("abÀÿé"), int(r.integers(4, 8)))) for _ in range(60)] + ["aaaaaa", "aaaaaaa", "aaabaaa"]
    long = "abcdefgh" * 9  # 72 letters, beyond LONG
    stems += [long, long[:-1], long[:30] + "x" + long[31:], long + "y", long[:62], long[:63], long[:64], long[:65], long[:10] + "zz" + long[10:62]]
    share = 1 / np.arange(1, len(stems) + 1)
    table = [(None if i % 40 == 0 else i, None if i % 17 == 0 else " ".join(s.title() if r.random() < 0.2 else s for s in r.choice(stems, 60, p=share / share.sum()))) for i in range(200)]
    table += [(1000 + i, " ".join(stems)) for i in range(3)] + [(5, "repeated Rows repeated " + f"{long} " * 40)] * 3 + [(6, "×÷×÷× ÀÀÀÀÀ ààààà ÀÀÀÀÀ àààà ÀÀÀÀÀ " + "q" * 700)] * 3
    frame = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
    got, want = spelled(frame, divisor=7), plain_variants(table, divisor=7)
    assert got == want and any(x[3] and len(x[0]) > 64 for x in want) and any(x[5] != x[3] and x[3] for x in want)
    assert spelled(spark.createDataFrame([], SCHEMA)) == [] and spelled(spark.createDataFrame([(1, None), (2, ""), (3, "12 34")], "doc_id long, text string")) == []


def test_keys_that_collide_are_told_apart(spark, monkeypatch):
    """Every key the same: strings alone decide."""
    words = spark.createDataFrame([(w, i + 1) for i, w in enumerate(["abcde", "abcdf", "abcd", "xbcde", "vwxyz", "abcdee"])], "word string, n long")
    want = {"abcde": 4, "abcdf": 2, "abcd": 2, "xbcde": 1, "abcdee": 1}  # insertions, deletions and replacements
    assert {r.word: r.n_near for r in spelling.neighbours(words).collect()} == want
    rows = [(p, w, 1) for w in want for p in range(-1, len(w))]
    found = Counter()
    for word, n, *_ in spelling.group_neighbours(rows):
        found[word] += n
    assert dict(found) == want


def test_crcs_of_joined_texts():
    r = np.random.default_rng(2)
    pairs = [(r.bytes(int(r.integers(0, 9))), r.bytes(int(r.integers(0, 255)))) for _ in range(300)]
    a, b = (np.array([zlib.crc32(x) for x in side], dtype=np.uint32) for side in zip(*pairs))
    assert spelling.combiner()(a, b, np.array([len(y) for _, y in pairs])).tolist() == [zlib.crc32(x + y) for x, y in pairs]


def test_runs_end_with_their_text():
    import pyarrow as pa

    data, offsets = spans.flat(pa.array(["ab", None, "cD e", "", "f"]))
    member = spans.WORD_BYTES[data]
    starts, ends = spans.runs(member, offsets)
    assert spans.column(data, member, starts, ends).to_pylist() == [b"ab", b"cd", b"e", b"f"]


@pytest.mark.parametrize("module", [exact_dedup, resampling, spelling])
def test_queries_equal_their_sql(spark, module):
    (name, query), (sql,) = *module.QUERIES.items(), module.ORACLES.values()
    frame = query(spark, SF)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(frame.columns)
    assert sorted(map(tuple, frame.select(*names).collect()), key=repr) == sorted(found.fetchall(), key=repr)
