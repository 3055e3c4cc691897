"""Personal data: exact base spans, and candidates chosen by boosted trees (native: DataFrame functions only).

Base spans (email, ip, card, phone) follow fixed patterns and are always reported. Beyond them, high-recall generators propose
overlapping candidates of further kinds (dotted-out addresses, account numbers, social security numbers, secrets, passwords,
national phone numbers, hardware and IPv6 addresses). Each candidate has features of format (length, digits, letters, cases,
groups, variety) and context (a telling word within `CONTEXT` characters before it, what touches it). Gradient-boosted trees score
it; per kind a threshold decides, the least score that on cases held out from the fit keeps a precision of `PRECISION` among all
that score as much, at the share of real ones that `PRIOR` expects. Chosen candidates that touch a base span or a candidate chosen before them are dropped.

The trees are fitted on the driver on `SAMPLE` labelled cases made by the formats below, a bound that does not follow the input,
and become one SQL expression. Every step is a projection of the row; rows are never shuffled. Patterns cannot backtrack or
recurse over long runs: quantified runs are possessive and start only where a run starts. Spans are gathered in time that grows
little faster than their number.

Defined cases: null or empty text: no spans (`redact` keeps null); very long texts, runs and many spans: as any other; repeated
rows: a row each; empty table: no rows. Further columns are carried, whatever their names; `find` puts its `base` and `chosen` in
the place of columns of these names, `redact` changes none but text and n_chars.
"""

from __future__ import annotations

import random
import re
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosting
from .common import RUN, documents, matches, scanned, text_or_empty

BASE = ("email", "ip", "card", "phone")
LOCAL = "A-Za-z0-9._%+-"
#: kind -> (substrings of which a text holds one where there is any; an empty one asks for a digit, pattern). \G lets a match begin where the last one ended, inside a run.
PATTERNS = {
    "email": (("@",), rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": ((".",), r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (("",), r"[0-9](?:[ -]?[0-9]){11,}+"),  # runs of fewer digits would all be dropped
    "phone": (("+",), r"\+[0-9][ ().0-9-]+[0-9]"),
}
CONTEXT, SAMPLE, PRECISION, SEED = 24, 6000, 0.95, 7
#: Share of real ones among what the generators propose in ordinary texts; made cases are half real, so false ones weigh more.
PRIOR = 0.2
#: kind -> (substrings of which a text, lowered, holds one where the kind can occur, generator); an empty one asks for a digit
CANDIDATES = {
    "account": (("",), r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "address": (("dot",), rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++ ?[\[(]?(?i:at)[\])]? ?[A-Za-z0-9-]{{1,63}} ?[\[(]?(?i:dot)[\])]? ?[A-Za-z]{{2,10}}(?![A-Za-z])"),
    "hardware": ((":",), r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){5}(?![0-9A-Fa-f:])"),
    "ipv6": ((":",), r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){3,7}|(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})?)?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?)(?![0-9A-Fa-f:])"),
    "national": (("",), r"(?<![A-Za-z0-9+])[(]?0?[0-9]{2,4}[)]?[ .-][0-9]{3,4}[ .-]?[0-9]{3,5}(?![A-Za-z0-9])"),
    "password": (("pass", "pwd", "secret"), r"(?<=[=:\" ])(?<=(?i:pass(?:word|wd|phrase|code)?|pwd|secret)[\"]?[ ]{0,2}[=:][ ]{0,2}[\"]?)[^\s\",;<>=:]{6,}+"),
    "secret": ((), r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20,}+={0,2}(?![A-Za-z0-9_])"),
    "social": (("-",), r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])"),
}
#: Telling words by kind, searched in lower case before the candidate: fixed values.
CUES = {
    "account": "iban|account|konto|compte|cuenta|bank",
    "address": "mail|contact|write|reach",
    "hardware": "mac|hwaddr|ether|device",
    "ipv6": "ip|address|host|inet|from",
    "national": "phone|tel|call|mobile|fax|cell|contact",
    "password": "pass|pwd|secret",
    "secret": "token|secret|key|password|passwd|pwd|api|bearer|auth|credential",
    "social": "ssn|social|security|taxpayer",
}
FEATURES = ["kind", "cue", "size", "digits", "uppers", "lowers", "marks", "variety", "assigned", "touches"]


# --- the sample -----------------------------------------------------------------------------------------------------------


def _case(r: random.Random, kind: str, real: bool) -> tuple[str, str, str]:
    """(text before, value, text after) of one labelled case."""
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    hexes = lambda n, a="0123456789abcdef": "".join(r.choice(a) for _ in range(n))
    words = lambda n: " ".join("".join(r.choice("aeilnorst") for _ in range(r.randint(2, 9))) for _ in range(n))
    cue = r.choice(CUES[kind].split("|"))
    mixed, upper, low = "abcdefghijkmnopqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "aeilnorst"
    # what else of that form stands in ordinary texts: part numbers, clock times, versions, dates, counts, digests, slugs, rules
    if kind == "account":
        value = r.choice(["DE", "FR", "ES", "GB"]) + d(2) + "".join(r.choice(["", " "]) + d(4) for _ in range(4)) if real else r.choice([hexes(2, upper) + d(2) + " " + hexes(4, upper) + " " + hexes(4, upper), hexes(2, upper) + d(2) + "".join(" " + d(4) for _ in range(2)), "NO" + d(2) + " " + hexes(4, upper) + " " + d(4)])
        told = r.random() < (0.6 if real else 0.05)
    elif kind == "address":
        value = f"{words(1)}{r.choice(['.', '', '_'])}{words(1)} {r.choice(['at', '[at]', '(at)'])} {words(1)} {r.choice(['dot', '[dot]', '(dot)'])} {r.choice(['com', 'org', 'net', 'de'])}" if real else f"{words(1)} at {words(1)} dot {words(1)}"
        told = r.random() < (0.8 if real else 0.03)
    elif kind == "hardware":
        value, told = (":".join(hexes(2) for _ in range(6)) if real else ":".join(d(2) for _ in range(6))), r.random() < (0.7 if real else 0.05)
    elif kind == "ipv6":
        value = r.choice([":".join(hexes(4) for _ in range(8)), ":".join(hexes(r.randint(1, 4)) for _ in range(r.randint(4, 8))), "fe80::" + hexes(r.randint(1, 4)), ":".join(hexes(4) for _ in range(2)) + "::" + ":".join(hexes(4) for _ in range(r.randint(1, 3)))]) if real else r.choice([hexes(1, "abcdef") + "::", "::" + hexes(r.randint(1, 2), "abcdef"),":".join(d(2) for _ in range(4)), ":".join(d(r.randint(1, 4)) for _ in range(5))])
        told = r.random() < (0.6 if real else 0.05)
    elif kind == "national":
        value = r.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"0{d(3)} {d(3)} {d(4)}"]) if real else r.choice([f"{d(4)}-{d(4)}", f"{d(3)} {d(3)} {d(3)}", f"{d(4)}.{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(4)} {d(4)}"])
        told = r.random() < (0.75 if real else 0.03)
    elif kind == "password":
        value = hexes(r.randint(6, 24), mixed + "0123456789!#$%_-" if r.random() < 0.7 else "0123456789abcdef") if real else r.choice([words(1) + words(1), "required", "forgotten", "changed", "policy.", "protected", "optional)"])
        told = True
    elif kind == "secret":
        size = r.choice([r.randint(20, 64), r.randint(64, 400)])
        value = r.choice([hexes(r.choice([32, 40, 64])), hexes(size, mixed + "23456789"), hexes(size, mixed), hexes(size, mixed + "0123456789_-"), hexes(r.choice([32, 40]), "0123456789ABCDEF"), "AKIA" + hexes(16, upper + "234567")]) if real else r.choice([hexes(size, low), d(r.randint(20, 30)), "-".join(words(4).split()), "/".join(words(5).split()), "_" * size, "-" * size, hexes(40), "/".join([words(1), d(4), d(2), d(2), "-".join(words(4).split())])])
        told = r.random() < ((0.5 if value.startswith("AKIA") else 0.95) if real else 0.03)
    else:
        value, told = f"{d(3)}-{d(2)}-{d(4)}", r.random() < (0.9 if real else 0.005)
    if kind == "password":
        return words(3) + " " + r.choice(["password", "passwd", "pwd", "Password", "Pwd", "pass", "secret"]) + r.choice([": ", "=", " = ", ':"', '="']), value, r.choice([" ", ",", '"', "\n"]) + words(1)
    joint = r.choice([": ", " = ", '="', " ", "=", " is "]) if told else " "
    return words(3) + " " + (cue if told else "") + joint, value, r.choice([" ", ".", ",", '"', "\n"]) + words(1)


def _features(kind: str, before: str, value: str, after: str) -> list[float]:
    b = before[-CONTEXT:]
    n = len(value)
    count = lambda p: len(re.findall(p, value))
    return [list(CANDIDATES).index(kind), float(bool(re.search(CUES[kind], b.lower()))), n, count("[0-9]"), count("[A-Z]"), count("[a-z]"), n - count("[0-9A-Za-z]"), len(set(value)), float(bool(re.search("[=:][ \"']*$", b))), float(b[-1:].isalnum() or after[:1].isalnum())]


@cache
def model() -> tuple[tuple[float, list], dict[str, float]]:
    """The trees, and for each kind the least log odds that kept the wished precision on the held-out half."""
    x, y = labelled(SAMPLE, SEED)
    half = SAMPLE // 2
    trees = boosting.fit(x[:half], y[:half], rounds=30)
    odds = boosting.margins(trees, x[half:])
    return trees, {kind: calibrated(odds[own], y[half:][own]) for i, kind in enumerate(CANDIDATES) for own in [x[half:, 0] == i]}


def labelled(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of n made cases."""
    r = random.Random(seed)
    cases = [(kind := r.choice(list(CANDIDATES)), real := r.random() < 0.5, _case(r, kind, real)) for _ in range(n)]
    return np.array([_features(kind, *parts) for kind, _, parts in cases]), np.array([float(real) for _, real, _ in cases])


def calibrated(odds: np.ndarray, truth: np.ndarray) -> float:
    """The least score at which PRECISION of all cases that score as much are real; halfway to the next lower score seen, equal scores being one.

    Never reached: a score that no case has.
    """
    levels = np.unique(odds)[::-1]
    real = np.array([truth[odds >= level].sum() for level in levels])
    false = np.array([(1 - truth[odds >= level]).sum() for level in levels]) * (1 - PRIOR) / PRIOR
    right = real / (real + false)
    good = np.flatnonzero(right >= PRECISION)
    if not len(good):
        return 99.0
    low = levels[good[-1]]
    return round(float((low + levels[good[-1] + 1]) / 2 if good[-1] + 1 < len(levels) else low - 1e-3), 5)


# --- expressions ----------------------------------------------------------------------------------------------------------


def _matches(gates: tuple[str, ...], pattern: str, text: str = "_pii_body") -> str:
    """Spans of a pattern in the body, looked for only where `text`, the body or its lowered form, holds one of the gates' substrings."""
    found = matches("_pii_body", f"r'{pattern}'", CONTEXT)
    if not gates:
        return found
    there = " or ".join(f"contains({text}, '{g}')" if g else "_pii_digit" for g in gates)
    return f"if({there}, {found}, cast(array() as array<struct<start:int,stop:int,value:string,before:string,after:string>>))"


DIGITS = "regexp_replace(s.value, '[^0-9]', '')"
LUHN = """(aggregate(sequence(1, length({d})), 0, (t, i) -> t + if((length({d}) - i) % 2 = 1,
  (2 * cast(substring({d}, i, 1) as int)) % 10 + int((2 * cast(substring({d}, i, 1) as int)) div 10), cast(substring({d}, i, 1) as int))) % 10 = 0)"""
PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
VALID = {
    "email": "true",
    "ip": rf"s.value rlike r'^{PART}\.{PART}\.{PART}\.{PART}$'",
    "card": f"length({DIGITS}) between 12 and 19 and {LUHN.format(d=DIGITS)}",
    "phone": f"length({DIGITS}) between 9 and 15",
}


def _spans(kind: str, order: int) -> str:
    """Base spans of one kind: failing matches are dropped."""
    made = "named_struct('start', s.start, 'place', {0}, 'stop', s.stop, 'kind', '{1}')".format(order, kind)
    return f"transform(filter(`_pii_{kind}`, s -> {VALID[kind]}), s -> {made})"


def _candidates(kind: str, order: int) -> str:
    before = "lower(s.before)"
    count = lambda p: f"length(regexp_replace(s.value, '[^{p}]', ''))"
    values = {
        "kind": str(list(CANDIDATES).index(kind)),
        "cue": f"int({before} rlike '{CUES[kind]}')",
        "size": "length(s.value)",
        "digits": count("0-9"),
        "uppers": count("A-Z"),
        "lowers": count("a-z"),
        "marks": "length(regexp_replace(s.value, '[0-9A-Za-z]', ''))",
        "variety": "size(array_distinct(split(s.value, '')))",
        "assigned": f"int({before} rlike r'[=:][ \"\\x27]*$')",
        "touches": "int(right(s.before, 1) rlike '[0-9A-Za-z]' or s.after rlike '[0-9A-Za-z]')",
    }
    shape = ", ".join(f"'{n}', double({values[n]})" for n in FEATURES)
    return f"transform({_matches(*CANDIDATES[kind], '_pii_low')}, s -> named_struct('start', s.start, 'place', {order}, 'stop', s.stop, 'name', '{kind}', 'f', named_struct({shape})))"


SPAN = "struct<start:int,place:int,stop:int,kind:string>"


def _found(docs: DataFrame) -> DataFrame:
    """docs + _pii_base and _pii_chosen: arrays of spans (start, place of the kind, stop, kind), in order of start, then kind."""
    trees, limits = model()
    rows = docs.withColumn("_pii_body", text_or_empty()).withColumn("_pii_digit", F.col("_pii_body").rlike("[0-9]")).withColumn("_pii_low", F.lower("_pii_body"))
    for kind, (gates, pattern) in PATTERNS.items():
        rows = rows.withColumn(f"_pii_{kind}", F.expr(_matches(gates, pattern)))
    rows = rows.withColumn("_pii_base", F.expr(f"array_sort(concat({', '.join(_spans(k, i) for i, k in enumerate(BASE))}))"))
    rows = rows.withColumn("_pii_proposed", F.expr(f"concat({', '.join(_candidates(k, len(BASE) + i) for i, k in enumerate(CANDIDATES))})"))
    odds = boosting.to_sql(trees, [f"c.f.{n}" for n in FEATURES])
    limit = "case c.name " + " ".join(f"when '{k}' then {v}D" for k, v in limits.items()) + " end"
    rows = rows.withColumn("_pii_likely", F.expr(f"filter(_pii_proposed, c -> {odds} >= {limit})"))
    # one pass in order of start over base spans, which always stay, and candidates; a candidate that begins before the last kept end goes
    known = "transform(_pii_base, b -> named_struct('start', b.start, 'place', b.place, 'stop', b.stop, 'kind', b.kind))"
    likely = "transform(_pii_likely, c -> named_struct('start', c.start, 'place', c.place, 'stop', c.stop, 'kind', c.name))"
    rows = rows.withColumn("_pii_chosen", F.expr(f"if(size(_pii_likely) = 0, cast(array() as array<{SPAN}>), {_apart(known, likely)})"))
    return rows.select(*docs.columns, "_pii_base", "_pii_chosen")


def _apart(known: str, likely: str) -> str:
    """The likely spans that overlap no known one, of overlapping ones the first: two passes, backwards for the next known start, then forwards."""
    merged = f"array_sort(concat({known}, {likely}))"
    value = "named_struct('start', x.start, 'place', x.place, 'stop', x.stop, 'kind', x.kind, 'limit', s)"
    back = scanned(f"reverse({merged})", "2147483647", "struct<start:int,place:int,stop:int,kind:string,limit:int>", "true", value, f"if(x.place < {len(BASE)}, x.start, s)")
    fits = f"x.place >= {len(BASE)} and x.start >= s and x.stop <= x.limit"
    return scanned(f"reverse({back})", "0", SPAN, fits, "named_struct('start', x.start, 'place', x.place, 'stop', x.stop, 'kind', x.kind)", f"if(x.place < {len(BASE)} or {fits}, greatest(s, x.stop), s)")


def find(docs: DataFrame) -> DataFrame:
    """docs + base and chosen."""
    kept = [c for c in docs.columns if c not in ("base", "chosen")]
    return _found(docs).select(*kept, F.col("_pii_base").alias("base"), F.col("_pii_chosen").alias("chosen"))


def listed(spans: str) -> Column:
    return F.expr(f"array_join(transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.stop)), ',')")


def redact(docs: DataFrame) -> DataFrame:
    """docs with [KIND] in place of every span; overlapping spans become one of the first's kind."""
    rows = _found(docs).withColumn("_pii_spans", F.expr("array_sort(concat(_pii_base, _pii_chosen))"))
    cuts = scanned("_pii_spans", "0", "struct<begin:int,start:int,kind:string>", "x.start >= s", "named_struct('begin', s, 'start', x.start, 'kind', x.kind)", "greatest(s, x.stop)")
    # a run's text is taken out once, for finding a place in a text means to walk through it
    pieces = f"""transform(array({cuts}), k -> transform(sequence(0, (size(k) - 1) div {RUN}), r -> transform(array(slice(k, r * {RUN} + 1, {RUN})), p ->
      transform(array(substring(_pii_text, p[0].begin + 1, element_at(p, -1).start - p[0].begin)), b ->
        array_join(transform(p, x -> concat(substring(b, x.begin - p[0].begin + 1, x.start - x.begin), '[', upper(x.kind), ']')), ''))[0])[0]))[0]"""
    end = "aggregate(_pii_spans, 0, (a, x) -> greatest(a, x.stop))"
    new = F.expr(f"concat(array_join({pieces}, ''), substring(_pii_text, {end} + 1))")
    rows = rows.withColumn("_pii_text", F.col("text")).withColumn("text", F.when(F.size("_pii_spans") > 0, new).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.size("_pii_spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return rows.select(*docs.columns)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find(documents(spark, sf_dir).select("doc_id", "text"))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in BASE]
    rows = rows.withColumn("spans", F.expr("array_sort(concat(base, chosen))"))
    return rows.select("doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


QUERIES = {"op5_pii": op5_pii}
ORACLES: dict[str, str] = {}
