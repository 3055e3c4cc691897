"""Cases with known results: windows, slop, detector, forensics, timeline, names, beats, files."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quillmill.config import DetectorConfig, from_env
from quillmill.functions import providers
from quillmill.functions import text as T
from quillmill.operators import characters, detector, forensics, language, scoring, slop, structure, text, timeline
from quillmill.plans import engine
from quillmill.sources import ingest, workspace
from quillmill.streaming import logs


def frame(spark, *texts, lang="en"):
    return spark.createDataFrame([(i, f"T{i}", lang, t) for i, t in enumerate(texts)], "doc_id long, title string, lang string, text string")


def words(n):
    return " ".join(["word"] * n)


def test_segments_cover_the_text(spark):
    got = text.segments(frame(spark, words(5000), "")).orderBy("idx").collect()
    assert [(r.start_token, r.end_token) for r in got] == [(0, 1500), (1300, 2800), (2600, 4100), (3900, 5000)]


@pytest.mark.parametrize("n, want", [(0, [(0, 0)]), (900, [(0, 900)]), (901, [(0, 900), (450, 901)]), (1200, [(0, 900), (450, 1200)])])
def test_windows(spark, n, want):
    rows = detector.tokenised(frame(spark, words(n)))
    assert [(r.start_word, r.end_word) for r in text.windows(rows).orderBy("w").collect()] == want


def test_slop_finds_repeats_and_leaves_a_draft(spark):
    block = "The corridor was sterile and the blood was dark with fear. " * 4
    made = ("Chapter 1: The Expanded Version\n\n" + "\n\n".join([block] * 4) + "\n\n") * 1
    draft = "I walked to the shop and bought some bread. Rain fell on the old roof while a cat slept by the door. We talked."
    bad, good, empty = slop.slop(frame(spark, made, draft, "")).orderBy("doc_id").collect()
    assert bad.repeated_blocks >= 1 and bad.max_repeat >= 3 and bad.dup_coverage >= 0.2 and bad.score >= 45 and bad.likely_ai and any("Verbatim" in f for f in bad.flags)
    assert not good.likely_ai and good.repeated_blocks == 0
    assert (empty.n_words, empty.score) == (0, 0) and empty.flags[0].startswith("Monotone")


def test_detector_override_empty_and_language(spark):
    part = "the sterile corridor hummed with certainty and fear " * 48
    rows = frame(spark, f"{part}\n\nchapter break\n\n{part}", "", words(3)).unionByName(frame(spark, "bonjour", lang="fr").withColumn("doc_id", F.lit(9).cast("long")))
    dup, empty, short, french = detector.detect(rows).orderBy("doc_id").collect()
    assert dup.word_count == 770 and dup.n_windows == 1 and round(dup.p_ai_max, 6) == 0.9 and round(dup.p_ai_doc, 6) == 0.825 and round(dup.ai_coverage_est, 6) == 0.72 and round(dup.confidence_doc, 6) == 0.8 and dup.n_overridden == 1
    assert round(empty.p_ai_doc, 6) == 0.274325 and round(empty.ai_coverage_est, 6) == 0.13505 and empty.n_windows == 1
    assert short.p_ai_doc is not None
    assert french.p_ai_doc is None and french.errors == ["bad_input"] and french.n_windows == 0 and french.word_count == 0


def test_long_repetition_is_not_saturated(spark):
    got = detector.detect(frame(spark, "A slow tide turned under the pale harbor lamps tonight. " * 1500)).first()
    assert got.n_windows == 33 and got.n_overridden == 33 and round(got.p_ai_doc, 6) == 0.825 and "possible_stitching" in got.flags


def test_providers_change_weights_and_fail_as_rows(spark):
    rows = frame(spark, words(30))
    wins = text.windows(detector.tokenised(rows))
    assert providers.score_windows(wins, None).first().score is None
    good = providers.score_windows(wins, lambda t: 1.0)
    bad = providers.score_windows(wins, lambda t: 1 / 0).first()
    assert bad.score is None and "division" in bad.error
    plain, scored = detector.window_signals(rows).first(), detector.window_signals(rows, lm=good).first()
    assert scored.lm == 1.0 and scored.p > plain.p and round(scored.conf - plain.conf, 6) == 0.2
    errors = providers.analyze_segments(text.segments(rows, 10, 0), lambda t: 1 / 0).collect()
    assert len(errors) == 3 and all(r.error for r in errors)
    assert providers.json_object('```json\n{"a":{"b":1}} tail```') == '{"a":{"b":1}}'


def test_config_from_env():
    c = from_env({"AI_WINDOW_WORDS": "100", "AI_BIAS": "x", "AI_LM_SCORING": "yes", "AI_NGRAM_N": "7"})
    assert (c.window_words, c.bias, c.lm_scoring, c.ngram) == (100, -0.20, True, 7) and from_env({}) == DetectorConfig()


def test_contradictions(spark):
    rows = [("d", c, "X", "eyes", v) for c, v in ((1, "blue"), (2, "Blue"), (3, "brown"), (4, "blue"), (5, "green"))] + [("l", 1, "John", "dead", "false"), ("l", 5, "John", "dead", "true"), ("r", 1, "John", "dead", "true"), ("r", 5, "John", "dead", "false")]
    raw = forensics.contradictions(spark.createDataFrame(rows, "doc_id string, chapter int, name string, attr string, value string"))
    got = [(r.chapter_a, r.value_a, r.chapter_b, r.value_b) for r in raw.where("doc_id = 'd'").orderBy("chapter_b").collect()]
    assert got == [(2, "Blue", 3, "brown"), (4, "blue", 5, "green")]
    assert raw.where("doc_id = 'l'").first().severity == "HIGH"
    assert [r.doc_id for r in forensics.plausible(raw).where("attr = 'dead'").collect()] == ["r"]
    entities, stored = forensics.tables(raw.where("doc_id = 'd'"))
    assert entities.count() == 1 and stored.count() == 2


def test_timeline_and_names(spark):
    got = timeline.events_around(frame(spark, "In 1999 we met. The next day everything changed. Last night he disappeared.")).orderBy("ord").collect()
    assert [r.time_marker for r in got] == ["1999", "next day", "Last night"] and all(r.event for r in got)
    names = frame(spark, "“Well, maybe.” Maybe. Not now. What a day! said Dawn. Dawn left.").select(characters.names(F.col("text")).alias("n")).first().n
    assert "Dawn" in names and not {"Well", "Maybe", "Not", "What"} & set(names)


def test_beats_and_metrics(spark):
    want = {1: [(1, 1)] * 3, 3: [(1, 1), (2, 2), (3, 3)], 8: [(1, 1), (4, 5), (7, 7)], 10: [(2, 2), (5, 6), (8, 8)], 20: [(3, 3), (10, 12), (16, 16)], 29: [(3, 4), (14, 16), (22, 23)], 30: [(4, 4), (14, 17), (23, 23)], 40: [(5, 5), (19, 23), (31, 31)], 100: [(11, 13), (46, 56), (76, 77)], 0: []}
    rows = spark.createDataFrame([(n, n) for n in want], "doc_id long, n int")
    got = {n: [] for n in want}
    for r in structure.beat_ranges(rows).orderBy("doc_id", "beat").collect():
        got[r.doc_id].append((r.start_chapter, r.end_chapter))
    assert got == want


def test_language_of_nothing(spark):
    r = language.language(frame(spark, "")).first()
    assert (r.spelling, r.grammar, r.readability, r.age, r.notes) == (0, 0, 0, "Unknown", [])


def test_files_and_workspace(spark, tmp_path):
    def docx(body):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("word/document.xml", f'<w:document xmlns:w="urn:w"><w:body>{body}</w:body></w:document>')
        return out.getvalue()

    src = tmp_path / "in"
    src.mkdir()
    (src / "a.docx").write_bytes(docx("<w:p><w:r><w:t>Chapter 1</w:t></w:r></w:p><w:p><w:r><w:t>John arrives in  1999.</w:t></w:r></w:p>"))
    (src / "b.txt").write_text("x")
    (src / "c.DOCX").write_bytes(b"no zip")
    (src / "d.pdf").write_bytes(b"%PDF")
    got = {r.title: r for r in ingest.read_files(spark, str(src)).collect()}
    assert got["a"].text == "Chapter 1\nJohn arrives in 1999." and got["a"].error is None
    assert got["b"].error == ingest.UNSUPPORTED and got["c"].error and got["d"].error
    tables = engine.analyze(ingest.read_files(spark, str(src)).where("error IS NULL"))
    assert tables["metrics"].first().n_words > 0 and tables["chapters"].count() == 1
    base = workspace.ensure(str(tmp_path / "ws"))
    folder = workspace.create_project(base, "  Demo ", "../x/..", b"1")
    assert (folder / "report.json").exists() and len(folder.name) == 12
    assert ingest.read_text(spark, str(src / "b.txt")).first().text == "x" and ingest.excerpt(spark, "  a\n\nb ").first().text == "a\n\nb"


def test_scores_and_errors(spark):
    row = spark.range(1).select(scoring.ai_penalty(F.lit(0.9), F.lit(0.5), F.lit(0.9), F.array(F.lit("ai_chunk_detected"), F.lit("widespread_ai_signal")), F.lit(50)).alias("p"), scoring.ai_penalty(F.lit(None).cast("double"), F.lit(0.5), F.lit(0.9), F.array(F.lit("x")), F.lit(50)).alias("n"), scoring.tool_error(F.lit("context deadline exceeded")).alias("e")).first()
    assert (row.p, row.n, row.e) == (70, 10, "timeout")


def test_stream_of_new_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.txt").write_text("Chapter 1\nJohn left.")
    seen = []
    logs.watch(spark, str(tmp_path / "in"), str(tmp_path / "cp"), lambda batch, _: seen.extend(r.text for r in batch.collect())).awaitTermination(120)
    assert seen == ["Chapter 1\nJohn left."]


def test_normal_forms(spark):
    r = spark.range(1).select(T.normal_text(F.lit(" A\r\nB,  don't!  ")).alias("n"), T.normal_block(F.lit("A-b  Cé!")).alias("b"), T.lines_tidied(F.lit(" a  b \n\n\t\nc")).alias("t")).first()
    assert (r.n, r.b, r.t) == ("a\nb don t!", "a b c", "a b\nc")


def test_evidence_of_repeats(spark):
    part = "the sterile corridor hummed with certainty and fear " * 48
    rows = frame(spark, f"{part}\n\nchapter break\n\n{part}", words(30))
    got = detector.window_evidence(rows, detector.window_signals(rows)).orderBy("doc_id", "w", "ord").collect()
    assert [(r.doc_id, r.w, r.ord, r.summary, r.start_word, r.end_word, r.top) for r in got] == [(0, 0, 1, "exact duplicated paragraph hash", 0, 384, True), (0, 0, 2, "long duplicate span", 0, 384, True)]
    assert (got[0].other_start, got[0].other_end) == (386, 770)
    tide = frame(spark, "A slow tide turned under the pale harbor lamps tonight. " * 1500)
    near = detector.window_evidence(tide, detector.window_signals(tide)).where("w = 0").orderBy("ord").collect()
    assert [r.summary for r in near] == ["near-duplication with w-002 (jaccard=1.00)", "long duplicate span"] and near[0].other_w == 2 and near[0].other_start == 900


def test_model_answers_take_the_place_of_heuristics(spark):
    rows = frame(spark, "Chapter 1 clue\nDetective work.\nChapter 2 evidence\nMore.\nChapter 3 end\nOver.", "plain text without headers")
    plain = engine.analyze(rows)

    def model(prompt):
        if "genre_scores" not in prompt:
            return '```json\n{"selected_structure": "", "structure_probabilities": {"three act": 3}, "beats": [{"name": "Turn", "start_chapter": 2, "end_chapter": 9, "is_beat": true, "reasoning": ""}]}```'
        if "More" in prompt:
            raise ValueError("connection refused")
        return 'Sure: {"genre_scores": {"Fantasy": 0.9, "Romance": 0.1}, "reasoning": "dragons"}'

    given = {"genre": engine.ask_genres(plain["chapters"], model), "plot": engine.ask_plots(plain, model)}
    tables = engine.analyze(rows, given=given)
    top = {(r.doc_id, r.genre): r.rank for r in tables["genres"].collect()}
    assert top[1, "Fantasy"] == 1 and top[0, "Fantasy"] == 1
    why = {r.doc_id: r.reasoning for r in tables["genre_reasons"].collect()}
    assert why[0].split("\n")[0] == "dragons" and "connection refused" in why[0]
    assert {r.doc_id: r.provider for r in tables["genre_providers"].collect()} == {0: "provider", 1: "provider"}
    assert {(r.doc_id, r.selected, r.provider) for r in tables["structure"].collect()} == {(0, "Three Act", "provider"), (1, "Three Act", "provider")}
    assert [(r.name, r.start_chapter, r.end_chapter, r.reasoning) for r in tables["beats"].where("doc_id = 0").collect()] == [("Turn", 2, 3, "Chapter 2 evidence More.")]
    assert plain["structure"].first().selected == "Save the Cat" and engine.report(rows, tables).count() == 2


def test_asking_stops_after_failures_and_timeouts(spark):
    import time

    rows = spark.createDataFrame([(d, c, "x") for d in (1, 2) for c in range(6)], "doc_id long, chapter int, prompt string").coalesce(1)

    def fails(text):
        raise ValueError("no such host")

    got = {(r.doc_id, r.chapter): r.error for r in providers.ask(rows, ["doc_id", "chapter"], "prompt", fails, failures=3).collect()}
    assert all(got[d, c] == ("no such host" if c < 3 else "not asked after failures") for d in (1, 2) for c in range(6))
    slow = providers.ask(rows.limit(1), ["doc_id", "chapter"], "prompt", lambda t: time.sleep(5), tries=1, seconds=0.2).first()
    assert slow.error == "timeout after 0.2 s" and scoring_kind(spark, slow.error) == "timeout"


def scoring_kind(spark, message):
    return spark.range(1).select(scoring.tool_error(F.lit(message))).first()[0]


def test_http_connectors():
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"]))
            answer = {"matches": [{}, {}]} if b"language=" in body else {"response": json.loads(body)["prompt"][::-1]}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(answer).encode())

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/"
    assert providers.http_model(url, "m")("abc") == "cba"
    assert providers.http_checker(url)(words(100)) == pytest.approx(1 - 20 / 45)
    server.shutdown()


def test_helpers_of_providers_and_reports(spark, tmp_path):
    rows = frame(spark, "Chapter 1 clue\nIn 1999 Mary ran.\nChapter 2 evidence\nMore.\nChapter 3 end\nOver.")
    tables = engine.analyze(rows)
    prompt = engine.prompt_plots(tables["metrics"], tables["summaries"], tables["timeline"]).first().prompt
    assert "Chapter 2" in prompt and "1999" in prompt
    wins = spark.range(100).select(F.lit(1).alias("doc_id"), F.col("id").cast("int").alias("w"))
    picked = [r.w for r in providers.sampled(wins).orderBy("w").collect()]
    assert picked == list(range(0, 72, 3)) and [r.w for r in providers.sampled(wins.where("w < 5")).orderBy("w").collect()] == [0, 3, 4]
    lang = language.language(rows)
    tool = spark.createDataFrame([(0, 50, 40, 120)], "doc_id long, spelling int, grammar int, readability int")
    safety = spark.createDataFrame([(0, 10, 20, 30, "")], "doc_id long, profanity int, explicit int, violence int, age string")
    both, one = language.overlaid(lang, tool, safety).first(), language.overlaid(lang, tool).first()
    assert (both.spelling, both.grammar, both.readability, both.violence, both.age) == (50, 40, 100, 30, "Unknown") and one.spelling == 50 and one.age == lang.first().age
    given = spark.createDataFrame([(0, 0, "", 0, 99, True, ""), (0, 1, "End", 7, 2, True, "why")], "doc_id long, beat int, name string, start_chapter int, end_chapter int, is_beat boolean, reasoning string")
    got = structure.provider_beats(given, tables["chapters"]).orderBy("beat").collect()
    assert [(r.name, r.start_chapter, r.end_chapter) for r in got] == [("Beat", 1, 3), ("End", 2, 2)] and got[1].reasoning == "why" and got[0].reasoning.startswith("Chapter 1")
    empty = engine.empty_report(spark).first()
    assert (empty.title, empty.status, empty.word_count) == ("No Manuscript Loaded", "IDLE", 0)


def test_saved_tables_and_traces(spark, tmp_path):
    told = []
    trace = logs.Trace(lambda percent, stage, detail: told.append((percent, stage)))
    rows = frame(spark, "Chapter 1 a\nx.\nChapter 2 b\ny.\nChapter 3 c\nz.")
    tables = engine.analyze(rows)
    saved = engine.save({k: tables[k] for k in ("chapters", "slop")}, str(tmp_path), trace)
    assert saved["chapters"].count() == 3 and saved["slop"].first().n_words == tables["slop"].first().n_words
    assert told == [(0, "chapters"), (50, "slop"), (100, "done")] and trace.lines(spark).count() == 3
    for i in range(500):
        trace(i, "more")
    assert len(trace.entries) == logs.TRACES and told[-1][0] == 100


def test_tables_are_made_once(spark):
    kinds = (spark.createDataFrame([], "entity_id string, name string").schema, spark.createDataFrame([], "entity_id string, severity string").schema)
    workspace.ensure_tables(spark, *kinds)
    spark.createDataFrame([("a", "b")], kinds[0]).write.mode("append").format("parquet").saveAsTable("entities")
    workspace.ensure_tables(spark, *kinds)
    assert workspace.count_rows(spark, "entities") == 1 and workspace.count_rows(spark, "contradictions") == 0
    spark.sql("DROP TABLE entities")
    spark.sql("DROP TABLE contradictions")


def test_chapter_files_snapshots_and_streams(spark, tmp_path):
    folder = tmp_path / "books" / "tide_chapters"
    folder.mkdir(parents=True)
    for i in (1, 2):
        (folder / f"chapter_00{i}.txt").write_text(f"text {i}")
    assert [(r.book, r.chapter, r.text) for r in ingest.read_chapters(spark, str(tmp_path / "books")).orderBy("chapter").collect()] == [("tide", 1, "text 1"), ("tide", 2, "text 2")]
    path = workspace.save_snapshot(spark.createDataFrame([(1, "x")], "doc_id long, title string"), str(tmp_path), "20260101-000000", "Run 7", "Save As")
    assert path.endswith("20260101-000000_run-7_save-as") and spark.read.json(path).count() == 1
    line = lambda s: ("2026-01-01 00:00:00", "t", "INFO", "s", s, "")
    spark.createDataFrame([line("a"), line("a"), line("b")], "ts string, time string, level string, stage string, message string, detail string").selectExpr("cast(ts AS timestamp) AS ts", "time", "level", "stage", "message", "detail").write.parquet(str(tmp_path / "lines"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "lines")).schema).parquet(str(tmp_path / "lines"))
    query = logs.merged_stream(stream).writeStream.format("memory").queryName("merged_lines").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(r.message for r in spark.table("merged_lines").collect()) == ["a", "b"]
