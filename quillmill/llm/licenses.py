"""Licence scans by ordered signature rules (native: DataFrame functions only).

A text's words are joined by single blanks and searched with signature rules: for each licence its SPDX tag, a grant ("licensed
under ...") and its bare name, and for many a sentence of its text or its address. A rule is tried only where its keyword, a
word of all that it matches and rare in prose, is among the text's words. Detections are resolved in order of
start, then length, then priority: one that lies within a detection kept before it, of its own priority or higher, is suppressed.

Every step is a projection of the row: no shuffle, and the rules are one constant array.

Defined cases: null or empty text: no words, no labels, score 0; very long texts: as any other; repeated rows: a row each; empty
table: no rows. Further columns are carried by `scan`, which puts its own in the place of columns of the same names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, matches, scanned, text_or_empty

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PLUS = r"([0-9])\+(?![0-9A-Za-z+])"
#: Phrase -> label of the base scan: fixed values.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Before a version's number; rules() lets a v stand right before the number too. LATER: what follows a version that may be a later one.
V = r"(?: v| version)?"
LATER = r"(?: plus| or(?: at your option)?(?: any)? later(?: version)?)"
#: (label, keyword, name as a regular expression over words joined by blanks)
NAMES = (
    ("mit", "license", r"(?:the )?mit(?: x11)? license"),
    ("mit", "licence", r"(?:the )?mit(?: x11)? licence"),
    ("mit-0", "attribution", r"mit no attribution(?: licen[sc]e)?"),
    ("mit-0", "0", r"mit 0(?: licen[sc]e)?"),
    ("x11", "x11", r"x11 licen[sc]e"),
    ("apache-1.0", "apache", rf"apache(?: software)? licen[sc]e{V} 1 0"),
    ("apache-1.1", "apache", rf"apache(?: software)? licen[sc]e{V} 1 1"),
    ("apache-2.0", "apache", rf"(?:apache(?: software)? licen[sc]e{V} 2(?: 0)?|apache 2(?: 0)? licen[sc]e)"),
    ("gpl-1.0", "public", rf"(?:gnu )?general public licen[sc]e{V} 1(?: 0)?"),
    ("gpl-2.0", "public", rf"(?:gnu )?general public licen[sc]e{V} 2(?: 0)?(?: only)?"),
    ("gpl-3.0", "public", rf"(?:gnu )?general public licen[sc]e{V} 3(?: 0)?(?: only)?"),
    ("gpl-2.0+", "public", rf"(?:gnu )?general public licen[sc]e{V} 2(?: 0)?{LATER}"),
    ("gpl-3.0+", "public", rf"(?:gnu )?general public licen[sc]e{V} 3(?: 0)?{LATER}"),
    ("gpl-2.0+", "gplv2", rf"(?:gnu )?gplv2{LATER}"),
    ("gpl-3.0+", "gplv3", rf"(?:gnu )?gplv3{LATER}"),
    ("gpl-2.0+", "gpl", rf"(?:gnu )?gpl{V} 2(?: 0)?{LATER}"),
    ("gpl-3.0+", "gpl", rf"(?:gnu )?gpl{V} 3(?: 0)?{LATER}"),
    ("lgpl-2.1+", "lesser", rf"(?:gnu )?lesser general public licen[sc]e{V} 2 1{LATER}"),
    ("lgpl-3.0+", "lesser", rf"(?:gnu )?lesser general public licen[sc]e{V} 3(?: 0)?{LATER}"),
    ("lgpl-2.1+", "lgpl", rf"(?:gnu )?lgpl{V} 2 1{LATER}"),
    ("lgpl-3.0+", "lgpl", rf"(?:gnu )?lgpl{V} 3(?: 0)?{LATER}"),
    ("agpl-3.0+", "agpl", rf"(?:gnu )?agpl{V} 3(?: 0)?{LATER}"),
    ("agpl-3.0+", "affero", rf"(?:gnu )?affero general public licen[sc]e{V} 3(?: 0)?{LATER}"),
    ("gpl", "gpl", r"gnu gpl"),
    ("gpl-2.0", "gplv2", r"(?:gnu )?gplv2"),
    ("gpl-3.0", "gplv3", r"(?:gnu )?gplv3"),
    ("lgpl-2.0", "library", rf"(?:gnu )?library general public licen[sc]e{V} 2(?: 0)?"),
    ("lgpl-2.1", "lesser", rf"(?:gnu )?lesser general public licen[sc]e{V} 2 1"),
    ("lgpl-3.0", "lesser", rf"(?:gnu )?lesser general public licen[sc]e{V} 3(?: 0)?"),
    ("lgpl", "lesser", r"(?:gnu )?lesser general public licen[sc]e"),
    ("agpl-3.0", "affero", rf"(?:gnu )?affero general public licen[sc]e{V} 3(?: 0)?"),
    ("agpl", "affero", r"(?:gnu )?affero general public licen[sc]e"),
    ("gfdl-1.2", "documentation", rf"(?:gnu )?free documentation licen[sc]e{V} 1 2"),
    ("gfdl-1.3", "documentation", rf"(?:gnu )?free documentation licen[sc]e{V} 1 3"),
    ("gfdl", "documentation", r"(?:gnu )?free documentation licen[sc]e"),
    ("bsd-0-clause", "bsd", r"(?:0|zero) clause bsd(?: licen[sc]e)?"),
    ("bsd-2-clause", "bsd", r"(?:bsd (?:2|two) clause(?: licen[sc]e)?|(?:2|two) clause bsd(?: licen[sc]e)?|simplified bsd licen[sc]e)"),
    ("bsd-3-clause", "bsd", r"(?:bsd (?:3|three) clause(?: licen[sc]e)?|(?:3|three) clause bsd(?: licen[sc]e)?|(?:new|modified) bsd licen[sc]e)"),
    ("bsd-4-clause", "bsd", r"(?:bsd (?:4|four) clause(?: licen[sc]e)?|(?:original|old) bsd licen[sc]e)"),
    ("bsd", "bsd", r"bsd(?: style)? licen[sc]e"),
    ("mpl-1.0", "mozilla", rf"mozilla public licen[sc]e{V} 1 0"),
    ("mpl-1.1", "mozilla", rf"mozilla public licen[sc]e{V} 1 1"),
    ("mpl-2.0", "mozilla", rf"mozilla public licen[sc]e{V} 2(?: 0)?"),
    ("mpl", "mozilla", r"mozilla public licen[sc]e"),
    ("epl-1.0", "eclipse", rf"eclipse public licen[sc]e{V} 1(?: 0)?"),
    ("epl-2.0", "eclipse", rf"eclipse public licen[sc]e{V} 2(?: 0)?"),
    ("edl-1.0", "eclipse", rf"eclipse distribution licen[sc]e{V} 1(?: 0)?"),
    ("cddl-1.0", "cddl", r"cddl(?: 1 0)?"),
    ("cddl-1.0", "distribution", rf"common development and distribution licen[sc]e{V} 1 0"),
    ("cddl-1.1", "distribution", rf"common development and distribution licen[sc]e{V} 1 1"),
    ("cpl-1.0", "common", rf"common public licen[sc]e(?:{V} 1(?: 0)?)?"),
    ("ipl-1.0", "ibm", rf"ibm public licen[sc]e(?:{V} 1(?: 0)?)?"),
    ("isc", "isc", r"isc licen[sc]e"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[sc]e"),
    ("libpng", "libpng", r"libpng licen[sc]e"),
    ("libpng", "png", r"png reference library licen[sc]e"),
    ("boost-1.0", "boost", rf"boost software licen[sc]e(?:{V} 1(?: 0)?)?"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("artistic-1.0", "artistic", rf"artistic licen[sc]e{V} 1(?: 0)?"),
    ("artistic-2.0", "artistic", rf"artistic licen[sc]e{V} 2(?: 0)?"),
    ("artistic", "artistic", r"artistic licen[sc]e"),
    ("psf-2.0", "python", rf"python(?: software foundation)? licen[sc]e(?:{V} 2(?: 0)?)?"),
    ("php-3.01", "php", rf"php licen[sc]e(?:{V} 3 01)?"),
    ("ruby", "ruby", r"ruby licen[sc]e"),
    ("openssl", "openssl", r"openssl licen[sc]e"),
    ("openldap-2.8", "openldap", rf"openldap public licen[sc]e(?:{V} 2 8)?"),
    ("ofl-1.1", "font", rf"(?:sil )?open font licen[sc]e(?:{V} 1 1)?"),
    ("eupl-1.1", "union", rf"european union public licen[sc]e{V} 1 1"),
    ("eupl-1.2", "union", rf"european union public licen[sc]e{V} 1 2"),
    ("eupl-1.1", "eupl", rf"eupl{V} 1 1"),
    ("eupl-1.2", "eupl", rf"eupl{V} 1 2"),
    ("eupl", "eupl", r"eupl"),
    ("lgpl", "lgpl", r"gnu lgpl"),
    ("agpl", "agpl", r"gnu agpl"),
    ("mit", "licensed", r"mit licensed"),
    ("bsd", "licensed", r"bsd licensed"),
    ("gpl", "licensed", r"gpl licensed"),
    ("isc", "licensed", r"isc licensed"),
    ("apache", "licensed", r"apache licensed"),
    ("cecill-2.1", "cecill", rf"cecill(?:{V} 2 1)?(?: licen[sc]e)?"),
    ("ms-pl", "microsoft", r"microsoft public licen[sc]e"),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[sc]e"),
    ("osl-3.0", "open", rf"open software licen[sc]e(?:{V} 3(?: 0)?)?"),
    ("afl-3.0", "academic", rf"academic free licen[sc]e(?:{V} 3(?: 0)?)?"),
    ("ncsa", "illinois", r"(?:university of illinois )?(?:ncsa )?open source licen[sc]e"),
    ("upl-1.0", "universal", rf"universal permissive licen[sc]e(?:{V} 1(?: 0)?)?"),
    ("vim", "vim", r"vim licen[sc]e"),
    ("tcl", "tcl", r"tcl(?: tk)? licen[sc]e"),
    ("postgresql", "postgresql", r"postgresql licen[sc]e"),
    ("odbl-1.0", "database", rf"open (?:data commons )?(?:open )?database licen[sc]e(?:{V} 1(?: 0)?)?"),
    ("odc-by-1.0", "commons", rf"open data commons attribution licen[sc]e(?:{V} 1(?: 0)?)?"),
    ("pddl-1.0", "dedication", r"(?:open data commons )?public domain dedication and licen[sc]e"),
    ("cc0-1.0", "cc0", rf"(?:creative commons )?cc0(?:{V} 1(?: 0)?)?"),
    ("cc-by-2.0", "cc", r"cc by 2 0"),
    ("cc-by-2.0", "creative", r"creative commons by 2 0"),
    ("cc-by-2.5", "cc", r"cc by 2 5"),
    ("cc-by-2.5", "creative", r"creative commons by 2 5"),
    ("cc-by-3.0", "cc", r"cc by 3 0"),
    ("cc-by-3.0", "creative", r"creative commons by 3 0"),
    ("cc-by-4.0", "cc", r"cc by 4 0"),
    ("cc-by-4.0", "creative", r"creative commons by 4 0"),
    ("cc-by-sa-3.0", "cc", r"cc by sa 3 0"),
    ("cc-by-sa-3.0", "creative", r"creative commons by sa 3 0"),
    ("cc-by-sa-4.0", "cc", r"cc by sa 4 0"),
    ("cc-by-sa-4.0", "creative", r"creative commons by sa 4 0"),
    ("cc-by-nd-4.0", "cc", r"cc by nd(?: 4 0)?"),
    ("cc-by-nd-4.0", "creative", r"creative commons by nd(?: 4 0)?"),
    ("cc-by-nc-3.0", "cc", r"cc by nc 3 0"),
    ("cc-by-nc-3.0", "creative", r"creative commons by nc 3 0"),
    ("cc-by-nc-4.0", "cc", r"cc by nc 4 0"),
    ("cc-by-nc-4.0", "creative", r"creative commons by nc 4 0"),
    ("cc-by-nc-sa-4.0", "cc", r"cc by nc sa(?: 4 0)?"),
    ("cc-by-nc-sa-4.0", "creative", r"creative commons by nc sa(?: 4 0)?"),
    ("cc-by-nc-nd-4.0", "cc", r"cc by nc nd(?: 4 0)?"),
    ("cc-by-nc-nd-4.0", "creative", r"creative commons by nc nd(?: 4 0)?"),
    ("cc-by-4.0", "attribution", r"creative commons attribution 4 0(?: international)?(?: licen[sc]e)?"),
    ("cc-by-sa-4.0", "attribution", r"creative commons attribution share ?alike 4 0(?: international)?(?: licen[sc]e)?"),
    ("cc-by-nc-4.0", "attribution", r"creative commons attribution non ?commercial 4 0(?: international)?(?: licen[sc]e)?"),
    ("cc", "creative", r"creative commons licen[sc]e"),
    ("public-domain", "domain", r"(?:in|into|to) the public domain"),
    ("proprietary", "proprietary", r"proprietary licen[sc]e"),
    ("busl-1.1", "business", rf"business source licen[sc]e(?:{V} 1 1)?"),
    ("sspl-1.0", "server", rf"server side public licen[sc]e(?:{V} 1(?: 0)?)?"),
    ("elastic-2.0", "elastic", rf"elastic licen[sc]e(?:{V} 2(?: 0)?)?"),
)
#: (label, keyword, priority, weight, sentence or address)
TEXTS = (
    ("mit", "hereby", 85, 0.95, r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("isc", "fee", 85, 0.95, r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution", 85, 0.9, r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "endorse", 86, 0.95, r"neither the names? of (?:(?!neither the names? of ).)+? nor the names of its contributors may be used to endorse or promote products"),
    ("bsd-4-clause", "advertising", 86, 0.95, r"all advertising materials mentioning features or use of this software must display"),
    ("apache-2.0", "compliance", 85, 0.95, r"you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2.0", "apache", 75, 0.85, r"apache org licenses license 2 0"),
    ("gpl", "redistribute", 85, 0.9, r"you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "redistribute", 86, 0.95, r"you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("agpl", "redistribute", 86, 0.95, r"you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("gpl", "gnu", 75, 0.8, r"gnu org licenses gpl(?: 2 0| 3 0)?"),
    ("lgpl", "gnu", 75, 0.8, r"gnu org licenses lgpl(?: 2 1| 3 0)?"),
    ("agpl", "gnu", 75, 0.8, r"gnu org licenses agpl(?: 3 0)?"),
    ("mpl-2.0", "mozilla", 85, 0.95, r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", "mpl", 75, 0.85, r"mozilla org mpl 2 0"),
    ("epl-2.0", "epl", 75, 0.85, r"eclipse org legal epl 2 0"),
    ("zlib", "zlib", 75, 0.8, r"zlib net zlib license"),
    ("zlib", "misrepresented", 85, 0.95, r"the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("boost-1.0", "boost", 75, 0.85, r"boost org license 1 0"),
    ("unlicense", "unencumbered", 85, 0.95, r"this is free and unencumbered software released into the public domain"),
    ("cc0-1.0", "creativecommons", 75, 0.85, r"creativecommons org publicdomain zero 1 0"),
    ("cc-by-4.0", "creativecommons", 75, 0.85, r"creativecommons org licenses by 4 0"),
    ("cc-by-sa-4.0", "creativecommons", 75, 0.85, r"creativecommons org licenses by sa 4 0"),
    ("cc-by-nc-4.0", "creativecommons", 75, 0.85, r"creativecommons org licenses by nc 4 0"),
    ("cc-by-nd-4.0", "creativecommons", 75, 0.85, r"creativecommons org licenses by nd 4 0"),
    ("proprietary", "reserved", 30, 0.4, r"all rights reserved"),
    ("unknown", "license", 20, 0.3, r"(?:licensed|released|distributed) under (?:the )?(?:terms of )?(?:the )?(?:[^ ]+ ){0,4}license"),
)
GRANT = r"(?:licensed|released|distributed|published|available|provided|covered|shared) (?:under|by|according to) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?"


#: Labels that are identifiers of two words or more with a version, which texts name bare: a name each, `-only` and `-or-later` with it.
BARE = sorted({label for label, *_ in NAMES if label[-1].isdigit() and "-" in label and not label.startswith("cc-")})


def rules() -> list[tuple[str, str, int, float, str]]:
    """(label, keyword, priority, weight, regular expression)."""
    found = []
    bare = [(label, label.split("-")[0], rf"{label.split('-')[0]}{V} {' '.join(label.replace('.', '-').split('-')[1:])}(?: only)?(?: licensed)?") for label in BARE]
    for label, keyword, name in [(a, k, n.replace(f"{V} ", f"{V} v?")) for a, k, n in (*NAMES, *bare)]:
        found.append((label, "spdx", 90, 1.0, "spdx license identifier " + label.replace(".", " ").replace("-", " ").replace("+", " or later")))
        found.append((label, keyword, 80, 0.9, GRANT + name))
        found.append((label, keyword, 50, 0.6, name))
    found += TEXTS
    return [(a, k, p, w, f"(?<![^ ])(?:{r})(?![^ ])") for a, k, p, w, r in dict.fromkeys(found)]


#: Priorities of the rules, from the lowest; a detection's level is its place here.
LEVELS = (20, 30, 50, 75, 80, 85, 86, 90)
OWN = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_detections")


def found() -> str:
    """SQL: detections of all rules whose keyword is among the words, in order of start, end downwards, priority downwards."""
    table = ", ".join(f"named_struct('label', '{a}', 'keyword', '{k}', 'level', {LEVELS.index(p)}, 'weight', {w}D, 'pattern', r'{r}')" for a, k, p, w, r in rules())
    spans = matches("_lic_joined", "r.pattern", 0)
    each = "named_struct('start', m.start, 'back', -m.stop, 'down', -r.level, 'label', r.label, 'weight', r.weight)"
    return f"array_sort(flatten(transform(filter(array({table}), r -> array_contains(_lic_present, r.keyword)), r -> transform({spans}, m -> {each}))))"


def resolved(detections: str) -> str:
    """SQL: the detections that lie in no other that is kept and has their priority or a higher one.

    The state is, by level, the furthest end of kept detections of that level or a higher one: all of them began before.
    """
    keep = "get(s, -x.down) < -x.back"
    after = f"if({keep}, transform(s, (e, l) -> if(l <= -x.down, greatest(e, -x.back), e)), s)"
    return scanned(detections, f"array_repeat(-1, {len(LEVELS)})", "struct<label:string,weight:double>", keep, "named_struct('label', x.label, 'weight', x.weight)", after)


def scan(docs: DataFrame) -> DataFrame:
    """docs + n_words, n_base, first_word, last_word, base_labels, labels, score, n_detections."""
    rows = docs.withColumn("_lic_lowered", F.translate(text_or_empty(), UPPER, LOWER))
    rows = rows.withColumn("_lic_words", F.regexp_extract_all("_lic_lowered", F.lit(WORD), F.lit(0)))
    rows = rows.withColumn("_lic_present", F.array_intersect("_lic_words", F.array(*map(F.lit, sorted({keyword for _, keyword, *_ in rules()})))))
    rows = rows.withColumn("_lic_n", F.size("_lic_words").cast("long"))
    rows = rows.withColumn("_lic_words", F.when(F.size("_lic_present") > 0, F.col("_lic_words")))
    # a plus behind a version is a word to the rules, and to nothing else
    plus = F.regexp_extract_all(F.regexp_replace("_lic_lowered", PLUS, "$1 plus"), F.lit(WORD), F.lit(0))
    rows = rows.withColumn("_lic_joined", F.when(F.col("_lic_words").isNotNull(), F.array_join(F.when(F.col("_lic_lowered").rlike(PLUS), plus).otherwise(F.col("_lic_words")), " "))).drop("_lic_lowered")
    at = " or ".join("(" + " and ".join(f"get(_lic_words, i + {k}) = '{w}'" for k, w in enumerate(p.split())) + ")" for p, _ in BASE)
    rows = rows.withColumn("_lic_places", F.expr(f"if(array_contains(_lic_present, 'license') and size(_lic_words) > 1, filter(sequence(0, size(_lic_words) - 2), i -> {at}), array())"))
    label = " ".join(f"when get(_lic_words, i) = '{p.split()[0]}' then '{name}'" for p, name in BASE)
    rows = rows.withColumn("_lic_base", F.expr(f"coalesce(array_sort(array_distinct(transform(_lic_places, i -> case {label} end))), array())"))
    rows = rows.withColumn("_lic_found", F.when(F.col("_lic_words").isNotNull(), F.expr(found())))
    rows = rows.withColumn("_lic_kept", F.coalesce(F.expr(resolved("_lic_found")), F.expr("cast(array() as array<struct<label:string,weight:double>>)")))
    labels = F.array_join(F.array_sort(F.array_union("_lic_base", "_lic_kept.label")), ",")
    n = F.when(F.col("_lic_places").isNull(), F.lit(0)).otherwise(F.size("_lic_places"))
    return rows.select(
        *[c for c in docs.columns if c not in OWN],
        F.col("_lic_n").alias("n_words"),
        n.cast("long").alias("n_base"),
        F.get("_lic_places", F.lit(0)).cast("long").alias("first_word"),
        F.get("_lic_places", F.size("_lic_places") - 1).cast("long").alias("last_word"),
        F.array_join("_lic_base", ",").alias("base_labels"),
        labels.alias("labels"),
        F.greatest(F.coalesce(F.array_max("_lic_kept.weight"), F.lit(0.0)), F.when(n > 0, F.lit(0.9)).otherwise(F.lit(0.0))).alias("score"),
        F.size("_lic_kept").cast("long").alias("n_detections"),
    )


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir).select("doc_id", "text")).drop("text")


QUERIES = {"op3_licenses": op3_licenses}
ORACLES: dict[str, str] = {}
