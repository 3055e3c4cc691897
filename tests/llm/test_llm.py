"""The training-data operators against brute force, with nulls, empty and long texts, ties, repeated rows, no rows and further columns."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillmill.llm import ann, boosting, licenses, mixing, near_dedup, packing, pii, quality, range_coder, registry, sharding, token_output, tokens, urls

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
W = r"[^\x20\x09-\x0D]+"
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
BASE = " ".join(f"tok{i}" for i in range(120))
TEXTS = [
    None, "", " ", "one", "a  b   c \n\n\n d\t e ", LONG, BASE, BASE, BASE.replace("tok60 ", "other "), BASE + "\nReleased under the MIT License. mail a.b@c-d.org +1 (555) 123-4567",
    "licensed under the apache license, version 2.0 or the GNU general public license version 3", "card 4111 1111 1111 1111 ip 10.0.0.255 and 10.0.0.256, 1.2.3.4.5.6.7.8", "x " * 300, "the same line here\nthe same line here\nother", "Ünïcode ß é́ 中文 <|endoftext|> \x00 \x01 it's", "a@b.c_x@y.z SSN: 123-45-6789 token = \"0123456789abcdef0123456789abcdef01234567\"",
]


def rows(texts=TEXTS):
    return [(i, t, "en", ["s0", "s1", None][i % 3], len(t or "")) for i, t in enumerate(texts)] + [(3, "one", "en", "s0", 3)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def encode(name, text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    return t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_tokenizer(name):
    import pyarrow as pa

    texts = [*TEXTS, "a \n b", "x\n\n", "\n\nx", "a\t b", "a \tb", "  lead", "trail  ", "a\r\nb", "\u2003 \u2003x", "...!? 12a3", "ΑΣ Σ"]
    for _ in range(2):  # the second time from memory
        values, offsets = tokens.encoder(public_tokenizers.path(name)).ids(pa.array(texts))
        assert [values[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [encode(name, t) for t in texts]


def test_range_coder_round_trip_and_damage():
    r = np.random.default_rng(0)
    for ids in (np.zeros(0, "<u2"), np.array([65535], "<u2"), r.integers(0, 65536, 3000).astype("<u2"), np.tile(r.integers(0, 50000, 50), 200).astype("<u2"), (r.zipf(1.2, 5000) % 50000).astype("<u2")):
        assert (range_coder.decode(range_coder.encode(ids)) == ids).all()
    ids = np.tile(r.integers(0, 50000, 50), 400).astype("<u2")
    frame = range_coder.encode(ids)
    assert len(frame) < len(ids)  # half of the plain ids at least is saved on repeats
    with pytest.raises(ValueError, match="damaged"):
        range_coder.decode(frame[:-40] + bytes(b ^ 255 for b in frame[-40:]))


def test_token_output(spark, docs, none, tmp_path):
    path = str(tmp_path / "ids")
    token_output.write_ids(docs.withColumn("ids", F.lit(1)), path, public_tokenizers.path(token_output.VOCABULARY))
    got = token_output.read_ids(spark, path).orderBy("start").collect()
    want = sorted(((i, encode(token_output.VOCABULARY, t) + [0]) for i, t, *_ in rows()), key=lambda x: x[0])
    assert [(r.doc_id, r.ids) for r in got] == want
    starts = np.cumsum([0, *[len(i) for _, i in want]])
    assert [(r.start, r.n_tokens, r.ids_crc32) for r in got] == [(s, len(i), zlib.crc32(np.array(i, "<u4"))) for s, (_, i) in zip(starts.tolist(), want)]
    token_output.write_ids(none, str(tmp_path / "no"), public_tokenizers.path(token_output.VOCABULARY))
    assert token_output.read_ids(spark, str(tmp_path / "no")).count() == 0


def test_packing(docs, none):
    path = public_tokenizers.path(packing.VOCABULARY)
    got = packing.pack(docs.withColumn("part", F.lit("clash")), path, window=100).orderBy("sequence_id", "offset").collect()
    want = Counter((i, tuple(encode(packing.VOCABULARY, t) + [1])) for i, t, *_ in rows())
    joined, at = {}, {}
    for r in got:
        assert r.offset == at.get(r.sequence_id, 0) and r.length == len(r.ids) <= 100 and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4"))
        at[r.sequence_id] = r.offset + r.length
        joined.setdefault((r.sequence_id * 100 + r.offset - r.start, r.doc_id), []).append(r)
    assert all(v == 100 for s, v in at.items() if s < max(at)) and sorted(at) == list(range(len(at)))
    assert Counter((d, tuple(x for r in sorted(p, key=lambda r: r.start) for x in r.ids)) for (_, d), p in joined.items()) == want
    assert packing.pack(none, path).count() == 0


def test_licenses(docs, none):
    assert len(licenses.rules()) > 200
    got = {(r.doc_id, r.n_words): r for r in licenses.scan(docs).collect()}
    for i, t, *_ in rows():
        w = re.findall(licenses.WORD, (t or "").translate(str.maketrans(licenses.UPPER, licenses.LOWER)))
        found = sorted((k, label) for phrase, label in licenses.BASE for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split())
        r = got[i, len(w)]
        assert (r.n_base, r.first_word, r.last_word) == (len(found), found[0][0] if found else None, found[-1][0] if found else None)
        assert r.base_labels == ",".join(sorted({x for _, x in found})) and {x for _, x in found} <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert {"apache-2.0", "gpl-3.0"} <= set(got[10, 16].labels.split(",")) or "apache-2.0" in got[10, 16].labels
    assert licenses.scan(none).count() == 0


def test_every_licence_rule_runs_where_it_matches(spark):
    want = {
        "Released under the GPLv3": "gpl-3.0", "GNU GPL": "gpl", "WTFPL": "wtfpl", "CDDL 1.0": "cddl-1.0", "EUPL": "eupl", "CC0 1.0": "cc0-1.0", "CC-BY-SA 4.0": "cc-by-sa-4.0", "CC BY-NC-ND": "cc-by-nc-nd-4.0", "BSD 3-Clause": "bsd-3-clause", "MIT-0": "mit-0",
        "MIT No Attribution": "mit-0", "PNG Reference Library License": "libpng", "see mozilla.org/MPL/2.0": "mpl-2.0", "All rights reserved": "proprietary", "into the public\ndomain": "public-domain", "Creative\nCommons BY 4.0": "cc-by-4.0",
        "you may not use this file except in compliance with the license. You may obtain a copy of the license at": "apache-2.0",
    }
    got = {r.text: r for r in licenses.scan(spark.createDataFrame([(t,) for t in want], "text string")).collect()}
    assert {t for t, label in want.items() if label not in got[t].labels.split(",") or not got[t].score} == set()


def reach(sets):
    """Components by brute force."""
    label = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    return label


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset([tuple(w)]) if 0 < len(w) < 5 else frozenset(zip(w, w[1:], w[2:], w[3:], w[4:]))


def near_texts():
    r = np.random.default_rng(3)
    words = [f"v{i}" for i in range(400)]
    out = []
    for g in range(6):
        base = r.choice(words, 150).tolist()
        for _ in range(1 + 7 * (g == 0) + g):
            copy = list(base)
            for k in r.choice(150, r.integers(0, 4), replace=False):
                copy[k] = f"e{r.integers(9999)}"
            out.append(" ".join(copy))
    return out + ["a b", "a b", "A B c d", "", None]


def test_near_dedup_equals_brute_force(spark, none):
    texts = near_texts()
    frame = spark.createDataFrame([(100 - i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(100, texts[0], "en", "s", 0)], SCHEMA)
    got = near_dedup.groups(frame).collect()
    label = reach([shingle_set(t) for t in texts])
    want = {}
    for i, x in enumerate(label):
        want[x] = min(want.get(x, 1000), 100 - i)
    assert len(got) == len(texts) + 1
    for r in got:
        i = 100 - r.doc_id
        assert (r.n_shingles, r.component_id, r.kept) == (len(shingle_set(texts[i])), want[label[i]], want[label[i]] == r.doc_id)
    stay = [r.doc_id for r in near_dedup.deduplicate(frame).collect()]
    assert set(stay) == {r.doc_id for r in got if r.kept}
    assert near_dedup.groups(none).count() == 0


def test_the_stage_links_from_80_percent_on(spark):
    words = [f"v{i}" for i in range(110)]
    copy = [f"e{i}" if i in (30, 70) else w for i, w in enumerate(words)]
    a, b = shingle_set(" ".join(words)), shingle_set(" ".join(copy))
    assert 0.80 <= len(a & b) / len(a | b) < 0.85
    frame = spark.createDataFrame([(1, " ".join(words), "en", "s", 0), (2, " ".join(copy), "en", "s", 0)], SCHEMA)
    assert [r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, frame, "").collect()] == [1]
    assert {r.component_id for r in near_dedup.groups(frame).collect()} == {1, 2}


def test_one_row_of_each_group_stays(spark):
    one, other, third, near = (" ".join(f"{c}{i}" for i in range(90)) for c in "abcd")
    table = [(1, one), (1, one), (2, one), (3, other), (1, other), (None, third), (None, third + " end"), (4, near), (None, near + " end"), (None, near), (9, None)]
    frame = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in table], SCHEMA)
    got = Counter((r.doc_id, (r.text or "-")[0]) for r in near_dedup.deduplicate(frame).collect())
    assert got == Counter({(1, "a"): 1, (1, "b"): 1, (None, "c"): 1, (4, "d"): 1, (9, "-"): 1})


def test_no_link_of_short_texts_is_missed(spark):
    texts = [t for i in range(300) for t in (" ".join(f"p{i}x{k}" for k in range(10)), " ".join(f"p{i}x{k}" for k in range(11)))]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert all(r.component_id == r.doc_id - r.doc_id % 2 for r in near_dedup.groups(frame).collect())


def test_near_dedup_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    texts = near_texts()
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    label = reach([shingle_set(t) for t in texts])
    assert {r.doc_id: r.component_id for r in near_dedup.groups(frame).collect()} == {i: label.index(x) for i, x in enumerate(label)}


def base_spans(text):
    """The base spans, plainly."""
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for place, (kind, p) in enumerate(kinds.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            luhn = sum(n - 9 * (n > 9) for n in (int(c) * (1 + j % 2) for j, c in enumerate(reversed(d)))) % 10 == 0
            if {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else True, "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]:
                out.append((m.start(), place, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def test_pii(docs, none):
    found = pii.find(docs).select("doc_id", "text", pii.listed("base").alias("b"), pii.listed("array_sort(concat(base, chosen))").alias("s")).collect()
    for r in found:
        assert r.b == ",".join(base_spans(r.text)) and set(filter(None, r.b.split(","))) <= set(r.s.split(","))
    assert any("secret" in r.s and "social" in r.s for r in found)
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert clean[0] is None and clean[6] == BASE and clean[11].startswith("card [CARD] ip [IP] and 10.0.0.256")
    assert pii.find(none).count() == 0


def test_secrets_of_any_length_and_of_letters_only(spark):
    r = np.random.default_rng(4)
    long = "".join(r.choice(list("abcdefghijkmnopqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789"), 342))
    letters = "".join(r.choice(list("abcdefghijkmnopqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ"), 40))
    frame = spark.createDataFrame([(i, f'api token = "{s}" end') for i, s in enumerate([long, letters])], "doc_id long, text string")
    assert {x.doc_id: x.text for x in pii.redact(frame).collect()} == {i: 'api token = "[SECRET]" end' for i in range(2)}


def test_boosting_on_held_out_cases():
    r = np.random.default_rng(1)
    x = r.integers(0, 20, (2000, 4)).astype(float)
    y = ((x[:, 0] > 9) & (x[:, 1] <= 5) | (x[:, 2] > 17)).astype(float)
    model = boosting.fit(x[:1000], y[:1000], rounds=20)
    assert ((boosting.predict(model, x[1000:]) > 0.5) == y[1000:]).mean() > 0.97


def test_sharding(docs, none):
    got = sharding.assign(docs.select("doc_id", "text"), 5, 8).collect()
    counts = Counter(r.shard for r in got)
    assert len(got) == len(rows()) and max(counts.values()) - min(counts.values()) <= 1 and len(counts) == 5
    for s, n in counts.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))
    assert all(r.size == len((r.text or "").encode()) + 16 and r.text_crc32 == zlib.crc32((r.text or "").encode()) for r in got)
    assert sharding.assign(none).count() == 0


def test_sharding_moves_little():
    owners = [s for s in range(10) for _ in range(4)]
    counts = {i: 10 + i % 3 for i in range(40)}
    runs = sharding.layout(counts, owners, 10)
    assert sum(b - a for _, a, b, _, _ in runs) == sum(counts.values())
    assert sum(b - a for arc, a, b, s, _ in runs if owners[arc] != s) < 0.2 * sum(counts.values())


def test_mixing(docs, none):
    got = mixing.schedule(docs).collect()
    size = lambda t: len(re.findall(W, t or ""))
    total = sum(size(t) for _, t, *_ in rows())
    sources = {"s0": 0, "s1": 0, None: 0}
    for _, t, _, s, _ in rows():
        sources[s] += size(t)
    weights, budget, goal, open_ = {"s0": 3, "s1": 1, None: 2}, 1.5 * total, {}, ["s0", "s1", None]
    while open_:  # cap and share again until none is above
        left = budget - sum(goal.values())
        level = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = [s for s in open_ if level[s] > 2 * sources[s]]
        goal |= {s: 2.0 * sources[s] for s in over} if over else level
        open_ = [s for s in open_ if s not in goal]
    for r in got:
        assert r.size == size(r.text) and abs(r.target - goal[r.source]) < 1e-6 and 0 <= r.taken <= 2 * r.size
    for s in sources:
        assert abs(sum(r.taken for r in got if r.source == s) - goal[s]) <= 1
    mix = mixing.mixture(docs).collect()
    assert sum(size(r.text) for r in mix) == sum(r.words for r in mix) == sum(r.taken for r in got)
    assert mixing.schedule(none).count() == 0 and mixing.mixture(none).count() == 0


def test_url_filter(spark):
    listed = [f"bad{i}.example.io/p" for i in range(200)]
    pages = [(i, f"https://www.bad{i}.example.io/p/?utm=1#x") for i in range(300)] + [(900, None), (901, "no scheme"), (902, "HTTP://A.Example.COM/en/7x"), (903, "http://example.com/en/1"), (904, "http://xcom/en/1"), (905, "x://de.net/de/8")]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame([(c,) for c in listed], "canonical string")).collect()}
    assert [got[i].verdict for i in range(300)] == ["block"] * 200 + ["allow"] * 100
    assert (got[900].host, got[900].path, got[900].verdict, got[901].host) == ("", "", "allow", "")
    assert (got[902].rule, got[902].verdict, got[903].rule, got[903].verdict, got[904].rule, got[905].verdict) == ("example.com/en/7", "allow", "com/en/", "block", None, "block")
    block = spark.createDataFrame([(c,) for c in listed], "canonical string")
    probe = spark.range(20000).select(F.concat(F.lit("other"), "id").alias("canonical"))
    words = urls.bloom(block, 50)
    b, m = urls.block_and_mask(F.col("canonical"), 50)
    passed = probe.withColumn("block", b).withColumn("mask", m).join(words, "block").where(F.col("word").bitwiseAND(F.col("mask")) == F.col("mask")).count()
    assert passed < 0.05 * 20000


def test_nearest_neighbours(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(1500, 16)).astype("f4")
    x[200:260] = x[200]
    table = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(5000, None, 1), (5100, [0.0] * 16, 1), (5200, [float("nan")] * 16, 1), (5300, [None] * 16, 1), (5400, [1.0] * 3, 1)]
    got = ann.search(spark.createDataFrame(table, "vec_id long, embedding array<float>, label int")).collect()
    hits = 0
    for q in range(0, 1500, 100):
        d = np.sqrt(((x.astype("f8") - x[q].astype("f8")) ** 2).sum(1))
        want = [i for i in np.lexsort((np.arange(1500), d)) if i != q][:10]
        own = sorted((g.rank, g.vec_id, g.score) for g in got if g.query_id == q)
        assert [k for k, *_ in own] == list(range(1, 14)) and all(abs(d[i] - s) < 1e-9 for _, i, s in own)
        hits += len({i for _, i, _ in own} & set(want))
        if q == 200:
            assert [i for _, i, _ in own] == want
    assert hits >= 0.9 * 150 and {g.query_id for g in got} == set(range(0, 1500, 100))
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def plain_quality(text):
    w = re.findall(W, text or "")
    tri = Counter(zip(w, w[1:], w[2:]))
    covered = {k + j for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(W, x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality(docs, none):
    table = quality.measured(docs)
    by = {(r.doc_id, r.n_words): r for r in quality.verdicts(table, quality.lost_words(table)).collect()}
    for i, t, *_ in rows():
        want = plain_quality(t)
        r = by[i, want[0]]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and r.kept == (not r.base_failed)
    assert quality.measured(none).count() == 0 and quality.clean(none).count() == 0


def test_frequent_lines_go_and_copies_do_not_count(spark):
    own = lambda i: " ".join(f"d{i}n{k}" for k in range(60))
    texts = [f"{own(i)}\nShared Footer  of the site" for i in range(30)] + [own(99) + f"\nsmall edit {i}" for i in range(30)]
    texts += ["shared footer of the site\n" + " ".join(["shared"] * 3)]
    frame = spark.createDataFrame([(i, t, "en", "h", 0) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r.text for r in quality.clean(frame).collect()}
    assert all(got[i] == own(i) for i in range(30)) and all(got[30 + i] == texts[30 + i] for i in range(30)) and 60 not in got


def test_a_shared_line_does_not_make_documents_copies(spark):
    own = lambda i: " ".join(f"d{i}n{k}" for k in range(60))
    low = sorted((f"shared line {i} of all pages" for i in range(400)), key=lambda x: quality.line_key(x.encode()))[:3]
    frame = spark.createDataFrame([(i, "\n".join([own(i), *low]), "en", "h", 0) for i in range(30)], SCHEMA)
    assert {r.doc_id: r.text for r in quality.clean(frame).collect()} == {i: own(i) for i in range(30)}


def test_the_limit_of_lines_does_not_follow_the_size_of_the_host(spark):
    own = lambda i: " ".join(f"d{i}n{k}" for k in range(60))
    texts = [own(i) + "\nshared footer" * (i < 25) for i in range(3000)]
    table = quality.measured(spark.createDataFrame([(i, t, "en", "h", 0) for i, t in enumerate(texts)], SCHEMA))
    assert quality.lost_words(table).count() == 25


def test_pipeline_equals_its_parts(spark, tmp_path):
    texts = near_texts()[:20] + [" ".join(f"q{i}z{k}" for k in range(80)) + " call +1 555 123 4567" for i in range(6)]
    spark.createDataFrame([(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = [i for i, t in enumerate(texts) if plain_quality(t)[0] >= 50]
    label = reach([shingle_set(texts[i]) for i in kept])
    stay = {kept[label.index(x)] for x in label}
    assert {r.doc_id for r in pieces} <= stay
    whole = Counter(r.doc_id for r in pieces if r.start == 0)
    size = {i: plain_quality(texts[i])[0] for i in stay}
    taken = sum(whole.values())
    assert taken >= len(stay) and max(whole.values()) <= 2
    redacted = [i for i in stay if "+1 555" in texts[i]]
    lengths = {r.doc_id: r.doc_tokens for r in pieces}
    assert redacted and all(lengths[i] != len(encode(packing.VOCABULARY, texts[i])) + 1 for i in redacted if i in lengths) and size


def test_registry_has_one_query_per_operator():
    names = registry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 14)) and "pipeline" in names
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
