"""Vectors of uneven spread lose no neighbours; every rule of the URL contract against plain Python; letters are encoded once."""

import numpy as np
import public_tokenizers
import pyarrow as pa

from quillmill.llm import ann, tokens, urls


def exact_hits(spark, x, every=100, k=10):
    table = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {}
    for g in ann.search(spark.createDataFrame(table, "vec_id long, embedding array<float>"), every=every).collect():
        got.setdefault(g.query_id, set()).add(g.vec_id)
    hits = total = 0
    for q in range(0, len(x), every):
        d = np.sqrt(((x.astype("f8") - x[q].astype("f8")) ** 2).sum(1))
        want = [i for i in np.lexsort((np.arange(len(x)), d)) if i != q][:k]
        hits, total = hits + len(got[q] & set(want)), total + k
    return hits / total


def test_sparse_queries_among_tight_clusters(spark):
    r = np.random.default_rng(4)
    x = (r.normal(size=(40, 24))[r.integers(0, 40, 4000)] + r.normal(size=(4000, 24)) * 1e-3).astype("f4")
    x[::100] = r.normal(size=(40, 24))  # queries that lie between the clusters
    assert exact_hits(spark, x) == 1.0


def test_codes_too_coarse_for_close_vectors(spark):
    r = np.random.default_rng(5)
    x = (np.ones(16) * 5 + r.normal(size=(5000, 16)) * 1e-3).astype("f4")
    x[4000:] = r.normal(size=(1000, 16)) * 50
    assert exact_hits(spark, x) == 1.0


def test_rules_of_the_contract(spark):
    hosts = ("com", "example.com", "a.EXAMPLE.com", "net", "x.example.net", "org", "xcom", "com.", "com:80", "u@example.com", ".com", "", "casino.com\n", "İ.com")
    paths = ("", "/", "/en/", "/en/7", "/en/78?x", "/EN/", "/de/", "/de/8", "/de/9", "/es/x/index.html", "?a=/en/", "#/en/", "//en/", "/en/" + "x" * 100_000)
    rows = [(i, u) for i, u in enumerate([None, *(p + h + q for p in ("http://", "", "a?b://", "x\n://") for h in hosts for q in paths)])]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame([], "canonical string")).collect()}
    for i, u in rows:
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:].split("?")[0].split("#")[0]
        fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        _, rule, verdict = max(fits) if fits else (0, None, "allow")
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict)


def test_letters_are_encoded_once_for_all_slices():
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        e = tokens.Encoder(public_tokenizers.path(name))
        full, sent, call = e.tokenizer, [], e._call
        e._call = lambda tokenizer, texts: sent.extend(texts) or call(tokenizer, texts)
        parts = [[f"{'' if i % 3 else 'x '}Étrange word{chr(97 + i % 26)}{chr(97 + i // 26)}, it's {i}!! and\nthen..." for i in range(a, b)] for a, b in ((0, 300), (200, 310), (0, 2), (0, 310))]
        for part in parts:
            sent.clear()
            values, offsets = e.ids(pa.array(part))
            assert [values[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [full.encode(t, add_special_tokens=False).ids for t in part]
        # all letters of the last part were there before: only punctuation, numbers and the like are encoded
        assert not any("word" in t for t in sent)
        assert 300 <= len(e.seen[0]) <= 330
