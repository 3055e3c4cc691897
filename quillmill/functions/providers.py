"""Optional scorers: grammar tool, smoothness, genre, safety and plot providers as Arrow-batched functions, with circuit breakers.

A provider is a Python callable; without one its columns are null and the heuristics stand. Failures are rows, never exceptions.
"""

from __future__ import annotations

import json
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DetectorConfig

#: What a model is told; own wording, for any wording that asks for the same keys will do.
STRUCTURE_PROMPT = """You edit novels. Below is what happens in one part of a manuscript.

{summary}

Decide whether this part works as the beat "{beat}". A Catalyst changes the hero's life for good; a Midpoint looks like winning or losing
but is neither; at All is Lost no hope is left. Reply with one JSON object and nothing else: "is_beat" (true or false) and "reasoning" (text)."""
COMP_TITLES_PROMPT = """You know the book trade. This is the synopsis of a manuscript:

{synopsis}

Name five real books of the past ten years that would stand beside it on the shelf, as a JSON array of titles. Write "Unknown" in place
of any title that you are not certain of."""
GENRE_PROMPT = """How much of each of these genres is in the excerpt below: {genres}? Reply with one JSON object: "top_genre" (a name from the list),
"genre_scores" (a number from 0 to 1 for every name, adding up to 1) and "reasoning" (one or two sentences on what shows it).

{sample}"""
SCORED = "doc_id long, w int, score double, error string"


def structure_prompt(summary: str, beat: str) -> str:
    return STRUCTURE_PROMPT.format(summary=summary, beat=beat).strip()


def comp_titles_prompt(synopsis: str) -> str:
    return COMP_TITLES_PROMPT.format(synopsis=synopsis).strip()


def genre_prompt(sample: Column, genres: tuple[str, ...]) -> Column:
    """The prompt column for a column of samples."""
    before, after = GENRE_PROMPT.format(genres=", ".join(genres), sample="\0").split("\0")
    return F.concat(F.lit(before), sample, F.lit(after))


def timed(call: Callable[[str], object], text: str, seconds: float | None) -> object:
    """call(text); TimeoutError if it takes longer. The call itself cannot be stopped and ends in its own thread."""
    if not seconds:
        return call(text)
    pool = ThreadPoolExecutor(1)
    try:
        return pool.submit(call, text).result(seconds)
    except TimeoutError:
        raise TimeoutError(f"timeout after {seconds:g} s") from None
    finally:
        pool.shutdown(wait=False)


def http_model(url: str, model: str, seconds: float = 120.0) -> Callable[[str], str]:
    """A model behind an HTTP endpoint that takes model, prompt, stream, format and options as JSON and answers with `response`."""

    def call(prompt: str) -> str:
        body = json.dumps({"model": model, "prompt": prompt, "stream": False, "format": "json", "options": {"temperature": 0}}).encode()
        request = urllib.request.Request(url, body, {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=seconds) as answer:
            return json.load(answer)["response"]

    return call


def http_checker(url: str, language: str = "en-US", seconds: float = 5.0) -> Callable[[str], float]:
    """A grammar tool behind an HTTP endpoint that takes a form of text and language and answers with `matches`: its score of a text."""

    def call(text: str) -> float:
        body = urllib.parse.urlencode({"text": text, "language": language}).encode()
        with urllib.request.urlopen(urllib.request.Request(url, body), timeout=seconds) as answer:
            issues = len(json.load(answer)["matches"])
        return max(0.0, min(1.0, 1.0 - issues * 1000.0 / max(1, len(text.split())) / 45.0))

    return call


def json_object(raw: str) -> str:
    """The first balanced {...} of a model's answer, fences taken off; braces in strings count like others."""
    raw = raw.strip().removeprefix("```json").removeprefix("```").removesuffix("```")
    depth = start = 0
    for i, c in enumerate(raw):
        if c == "{":
            start, depth = (i if depth == 0 else start), depth + 1
        elif c == "}" and depth:
            depth -= 1
            if depth == 0:
                return raw[start : i + 1]
    return ""


def grammar_score(issues_per_1k: Column) -> Column:
    """1 for no issues, 0 from 45 per 1,000 words."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - issues_per_1k / 45.0))


def sampled(windows: DataFrame, c: DetectorConfig = DetectorConfig()) -> DataFrame:
    """Windows that a costly tool looks at: the first, the last and every third, up to a cap per document."""
    last = F.max("w").over(Window.partitionBy("doc_id"))
    picked = windows.withColumn("_last", last).where((F.col("w") == 0) | (F.col("w") == F.col("_last")) | (F.col("w") % c.language_tool_stride == 0)).drop("_last")
    return picked.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy("w"))).where(F.col("_n") <= c.language_tool_max_windows).drop("_n")


def score_windows(windows: DataFrame, scorer: Callable[[str], float] | None, failures: int = 3, seconds: float | None = None) -> DataFrame:
    """windows(doc_id, w, words) -> doc_id, w, score, error; after `failures` in a row a document's later windows are left out. seconds: the most a call may take."""
    texts = windows.select("doc_id", "w", F.array_join("words", " ").alias("text"))
    if scorer is None:
        return texts.select("doc_id", "w", F.lit(None).cast("double").alias("score"), F.lit("not available").alias("error"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc, bad = None, 0
        for batch in batches:
            rows = []
            for d, w, text in zip(batch["doc_id"], batch["w"], batch["text"]):
                if d != doc:
                    doc, bad = d, 0
                if bad < failures:
                    try:
                        rows.append((d, w, float(timed(scorer, text, seconds)), None))
                        bad = 0
                    except Exception as e:
                        rows.append((d, w, None, str(e)))
                        bad += 1
            yield pd.DataFrame(rows, columns=["doc_id", "w", "score", "error"])

    return texts.repartition("doc_id").sortWithinPartitions("doc_id", "w").mapInPandas(run, SCORED)


def analyze_segments(segments: DataFrame, analyzer: Callable[[str], None]) -> DataFrame:
    """Run a callable on every segment -> doc_id, idx, error; all errors are collected, none stops the others."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            errors = []
            for text in batch["text"]:
                try:
                    analyzer(text)
                    errors.append(None)
                except Exception as e:
                    errors.append(str(e))
            yield batch[["doc_id", "idx"]].assign(error=errors)

    return segments.select("doc_id", "idx", "text").mapInPandas(run, "doc_id long, idx int, error string")


def ask(rows: DataFrame, key: list[str], prompt: str, model: Callable[[str], str] | None, tries: int = 3, failures: int | None = None, seconds: float | None = None) -> DataFrame:
    """A model's JSON answers by key: rows(key..., prompt column) -> key..., answer (a JSON object), error; up to `tries` calls a row.

    With `failures`, rows are asked in order of key, and after so many failed rows in a row the later rows of the same first key
    are not asked. seconds: the most a call may take.
    """
    if model is None:
        return rows.select(*key, F.lit(None).cast("string").alias("answer"), F.lit("not available").alias("error"))

    def one(text: str) -> tuple[str | None, str | None]:
        error = None
        for _ in range(tries):
            try:
                answer = json_object(timed(model, text, seconds))
                json.loads(answer)
                return answer, None
            except Exception as e:
                error = str(e) or type(e).__name__
        return None, error

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        owner, bad = None, 0
        for batch in batches:
            answers, errors = [], []
            for first, text in zip(batch[key[0]], batch[prompt]):
                if first != owner:
                    owner, bad = first, 0
                answer, error = (None, "not asked after failures") if failures is not None and bad >= failures else one(text)
                bad = 0 if error is None else bad + 1
                answers.append(answer)
                errors.append(error)
            yield batch[key].assign(answer=answers, error=errors)

    schema = ", ".join(f"{c} {t}" for c, t in rows.select(*key).dtypes)
    asked = rows.select(*key, prompt)
    if failures is not None:
        asked = asked.repartition(key[0]).sortWithinPartitions(*key)
    return asked.mapInPandas(run, f"{schema}, answer string, error string")
