"""Names, events, actions and summaries of chapters, and the character dictionary of a manuscript."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.mentions import placed
from .text import TURNS, sql_fields, sql_first, sql_trim, turns

# Fixed values.
EVENT_VERBS = "arrived|left|discovered|revealed|decided|confronted|killed|died|escaped|found|lost|won|failed|confessed|attacked|agreed|refused|warned|promised|betrayed|collapsed|resigned|married|divorced|fled|returned|investigated|accused|admitted|exposed"
CAUSAL = "because|therefore|after|before|when|then|suddenly|finally|meanwhile|later"
MARKERS = "next day|yesterday|today|tomorrow|last night|[0-9]{4}"
SPEECH = "said|asked|replied|whispered|shouted|murmured|called|told|answered|cried|snapped"
WEAK = ("What", "Maybe", "Not", "Well", "Yes", "No", "Oh", "Ah", "Hmm", "However", "Anyway", "Therefore", "Meanwhile", "Then", "Also", "Still")
IGNORED = ("He", "She", "They", "Them", "Their", "The", "This", "That", "There", "You", "We", "I", "It", "His", "Her", "Our", "Your", "A", "An", "And", "But")
EVENTS, EVENT_WORDS, ACTIONS, ACTION_WORDS = 4, 22, 3, 18
NO_ACTION = "No direct action sentence extracted."
E, S = T.EDGE, r"[\t\n\f\r ]"


def whole(words: str) -> str:
    """One of the words, as whole words: where one may begin its first letter is looked at before all else."""
    first = "".join(sorted({"0-9" if w[0] == "[" else w[0] for w in words.split("|")}))
    return f"(?=[{first}]){T.BEGIN}({words}){T.END}"


#: A capitalised word.
NAME = f"(?=[A-Z]){T.BEGIN}[A-Z][a-z]{{2,}}+{T.END}"


def strong_evidence(name: str, t: Column) -> Column:
    """A weak word is a name where it owns something, is addressed, titled or speaks."""
    patterns = (f"(?i){E}(mr|mrs|ms|dr|prof)\\.?{S}+{name}{E}", f"(?i){E}{name}{E}{S}+{E}({SPEECH}){E}", f"(?i){E}({SPEECH}){E}{S}+{E}{name}{E}")
    found = t.contains(name + "'s") | t.contains(name + "’s") | t.contains(f",{name},")
    for p in patterns:
        found = found | t.rlike(p)
    return found


def names(t: Column) -> Column:
    """Different capitalised words in order of appearance, without pronouns, articles and weak words that nothing supports."""
    found = F.array_distinct(T.find_all(t, NAME))

    def keep(n: Column) -> Column:
        weak = F.lit(None).cast("boolean")
        for w in WEAK:
            weak = F.when(n == w, strong_evidence(w, t)).otherwise(weak)
        return ~n.isin(*IGNORED) & F.when(n.isin(*WEAK), F.coalesce(weak, F.lit(True))).otherwise(True)

    return F.filter(found, keep)


def rated(sentences: Column) -> Column:
    """array<struct<s, acts, causal>>: each sentence, and whether it has an event verb and a causal word."""
    own = lambda s: T.let(F.lower(s), lambda low: F.struct(s.alias("s"), low.rlike(whole(EVENT_VERBS)).alias("acts"), low.rlike(whole(CAUSAL)).alias("causal")))
    return F.transform(sentences, own)


def ranked_sentences(rated_: Column) -> Column:
    """Sentences of rated() that score, best first: longer ones (in bytes), then earlier ones, before their equals."""

    def scored(x: Column, i: Column) -> Column:
        s, acts = x["s"], x["acts"]
        one = lambda c, n: F.when(c, n).otherwise(0)
        score = one(acts, 4) + one(x["causal"], 2) + one(s.rlike("(?i)" + whole(MARKERS)), 2) + one(s.rlike(NAME), 1) - one(~acts & s.rlike(f"^{S}*[\"']"), 1) - one(F.size(F.filter(F.split(s, f"{T.WIDE}+", 8), lambda x: x != "")) < 6, 1)
        return F.struct((-score).alias("down"), (-F.octet_length(s)).alias("short"), i.alias("pos"), s.alias("s"))

    return F.array_sort(F.filter(F.transform(rated_, scored), lambda x: x["down"] < 0))


def events(rows: DataFrame) -> DataFrame:
    """rows(..., text) + rated, events: up to four, without repeats; a text without any has its first words. Sentences behind the fourth event are not looked at."""
    rows = rows.withColumn("rated", rated(T.kept_sentences(F.col("text")))).withColumn("ranked", ranked_sentences(F.col("rated")))
    empty = F.array().cast("array<string>")
    added = lambda a, s: F.when(F.array_contains(F.transform(a, F.lower), F.lower(s)), a).otherwise(F.concat(a, F.array(s)))
    kept = F.aggregate("ranked", empty, lambda a, x: F.when(F.size(a) >= EVENTS, a).otherwise(T.let(T.first_words(x["s"], EVENT_WORDS), lambda s: added(a, s))))
    return rows.withColumn("events", F.when(F.size("ranked") > 0, kept).otherwise(F.array(T.first_words(F.col("text"), EVENT_WORDS)))).drop("ranked")


def summary(found: Column, t: Column) -> Column:
    return F.when(F.size(found) >= 2, F.concat(T.first_words(found[0], 20), F.lit(" | "), T.first_words(F.get(found, F.lit(1)), 20))).when(F.size(found) == 1, T.first_words(found[0], 24)).otherwise(T.first_words(t, 36))


def chapter_summaries(chaps: DataFrame) -> DataFrame:
    """chapters -> doc_id, chapter, title, events, summary, names."""
    rows = events(chaps)
    return rows.select("doc_id", "chapter", "title", "events", summary(F.col("events"), F.col("text")).alias("summary"), names(F.col("text")).alias("names"))


def with_cast(rows: DataFrame) -> DataFrame:
    """rows(names, rated, ...) + cast: array<struct<name, mentions, actions>>, a name each.

    actions: up to three sentences that hold the name, those with event verbs and causes first. All names of a text are looked for in one pass,
    so its cost does not grow with their number times the text.
    """
    weight = F.transform("rated", lambda x: F.lit(0) + F.when(x["acts"], 3).otherwise(0) + F.when(x["causal"], 1).otherwise(0))
    rows = rows.withColumn("_found", placed(F.col("names"), F.transform("rated", lambda x: x["s"]), weight, ACTIONS))
    told = lambda x: F.transform(x["places"], lambda i: T.first_words(F.get(F.col("rated"), i)["s"], ACTION_WORDS))
    acted = lambda x: F.when(F.size(x["places"]) > 0, told(x)).otherwise(F.array(F.lit(NO_ACTION)))
    own = F.transform("names", lambda n, i: T.let(F.get(F.col("_found"), i), lambda x: F.struct(n.alias("name"), x["mentions"].alias("mentions"), acted(x).alias("actions"))))
    return rows.withColumn("cast", own).drop("_found")


def character_chapters(chaps: DataFrame) -> DataFrame:
    """doc_id, name, chapter, mentions, actions; rows with with_cast()'s column have them already."""
    rows = chaps
    if "cast" not in chaps.columns:
        rows = with_cast(chaps.select("doc_id", "chapter", rated(T.kept_sentences(F.col("text"))).alias("rated"), names(F.col("text")).alias("names")))
    return rows.select("doc_id", "chapter", F.explode_outer("cast").alias("x")).where("x IS NOT NULL").select("doc_id", "x.name", "chapter", "x.mentions", "x.actions")


def dictionary(chaps: DataFrame) -> DataFrame:
    """One row per name: first and last chapter, mentions, and its chapters' records; order by mentions, then name, where it matters."""
    return character_chapters(chaps).groupBy("doc_id", "name").agg(F.min("chapter").alias("first_chapter"), F.max("chapter").alias("last_chapter"), F.sum("mentions").alias("mentions"), F.sort_array(F.collect_list(F.struct("chapter", "mentions", "actions"))).alias("chapters"))


STORY = ("\n“Well, not now,” said Dawn. Maybe John arrived because Mary left on the next day of 1999. Then it ended. John's brother confessed that he found the letter before noon! 'Not today' was all. Well said nothing; Dr. Still returned.", "\nMary decided to leave town after the storm when John failed. Nothing else.", "")


def storied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation chapters with sentences put in that have names, events and markers."""
    rows = turns(spark, sf_dir)
    k = F.col("chapter") % 3
    return rows.withColumn("text", F.concat("text", F.when(k == 0, F.lit(STORY[0])).when(k == 1, F.lit(STORY[1])).otherwise(F.lit(STORY[2]))))


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chapter_summaries(storied(spark, sf_dir))
    return rows.select("doc_id", "chapter", F.array_join("events", "|").alias("events"), "summary", F.array_join("names", ",").alias("names"))


def character_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary(storied(spark, sf_dir)).select("doc_id", "name", "first_chapter", "last_chapter", "mentions", F.size("chapters").alias("n_chapters"))


def character_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return character_chapters(storied(spark, sf_dir)).where("name IN ('John', 'Mary', 'Dawn', 'Still')").withColumn("actions", F.array_join("actions", "|"))


_q = lambda s: "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
STORIED = f"(SELECT doc_id, chapter, title, text || CASE chapter % 3 WHEN 0 THEN {_q(STORY[0])} WHEN 1 THEN {_q(STORY[1])} ELSE '' END AS text FROM {TURNS})"
_SENT = f"s AS (SELECT doc_id, chapter, i AS pos, ss[i] AS s FROM (SELECT doc_id, chapter, ss, unnest(range(1, len(ss) + 1)) AS i FROM (SELECT doc_id, chapter, list_filter(list_transform(regexp_extract_all(text, '[^.!?]+[.!?]?'), lambda s: {sql_trim('s')}), lambda s: s <> '') AS ss FROM {STORIED})))"
_EVENTS = rf"""{_SENT},
r AS (SELECT *, 4 * regexp_matches(lower(s), '\b({EVENT_VERBS})\b')::INT + 2 * regexp_matches(lower(s), '\b({CAUSAL})\b')::INT + 2 * regexp_matches(s, '(?i)\b({MARKERS})\b')::INT + regexp_matches(s, '\b[A-Z][a-z]{{2,}}\b')::INT - (regexp_matches(s, '^\s*["'']') AND NOT regexp_matches(lower(s), '\b({EVENT_VERBS})\b'))::INT - (len({sql_fields('s')}) < 6)::INT AS score FROM s),
o AS (SELECT doc_id, chapter, {sql_first('s', 22)} AS e, row_number() OVER (PARTITION BY doc_id, chapter ORDER BY score DESC, strlen(s) DESC, pos) AS k FROM r WHERE score > 0),
u AS (SELECT doc_id, chapter, arg_min(e, k) AS e, min(k) AS k FROM o GROUP BY doc_id, chapter, lower(e)),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, chapter ORDER BY k) AS n FROM u),
ev AS (SELECT c.doc_id, c.chapter, c.title, c.text, coalesce(list(e ORDER BY n) FILTER (n <= 4), [{sql_first('any_value(c.text)', 22)}]) AS events FROM {STORIED} c LEFT JOIN f ON c.doc_id = f.doc_id AND c.chapter = f.chapter GROUP BY c.doc_id, c.chapter, c.title, c.text)"""
_weak = " ".join(f"WHEN '{w}' THEN contains(text, '{w}''s') OR contains(text, '{w}’s') OR contains(text, ',{w},') OR regexp_matches(text, '(?i)\\b(mr|mrs|ms|dr|prof)\\.?\\s+{w}\\b|\\b{w}\\b\\s+\\b({SPEECH})\\b|\\b({SPEECH})\\b\\s+\\b{w}\\b')" for w in WEAK)
_ig = ", ".join(f"'{w}'" for w in IGNORED)
_NAMES = rf"nm AS (SELECT doc_id, chapter, text, n, min(i) AS i FROM (SELECT doc_id, chapter, text, ns[i] AS n, i FROM (SELECT doc_id, chapter, text, ns, unnest(range(1, len(ns) + 1)) AS i FROM (SELECT *, regexp_extract_all(text, '\b[A-Z][a-z]{{2,}}\b') AS ns FROM {STORIED}))) WHERE n NOT IN ({_ig}) AND CASE n {_weak} ELSE true END GROUP BY doc_id, chapter, text, n)"
QUERIES = {"chapter_summaries": summaries, "character_dictionary": character_dictionary, "character_actions": character_actions}
ORACLES = {
    "chapter_summaries": f"WITH {_EVENTS}, {_NAMES}, na AS (SELECT doc_id, chapter, string_agg(n, ',' ORDER BY i) AS names FROM nm GROUP BY doc_id, chapter) SELECT ev.doc_id, ev.chapter, array_to_string(events, '|') AS events, CASE WHEN len(events) >= 2 THEN {sql_first('events[1]', 20)} || ' | ' || {sql_first('events[2]', 20)} WHEN len(events) = 1 THEN {sql_first('events[1]', 24)} ELSE {sql_first('text', 36)} END AS summary, coalesce(names, '') AS names FROM ev LEFT JOIN na USING (doc_id, chapter)",
    "character_dictionary": f"WITH {_NAMES} SELECT doc_id, n AS name, min(chapter) AS first_chapter, max(chapter) AS last_chapter, sum((length(text) - length(replace(text, n, ''))) // length(n))::BIGINT AS mentions, count(*)::INT AS n_chapters FROM nm GROUP BY doc_id, n",
    "character_actions": rf"WITH {_SENT}, {_NAMES}, h AS (SELECT nm.doc_id, nm.chapter, n, {sql_first('s', 18)} AS a, row_number() OVER (PARTITION BY nm.doc_id, nm.chapter, n ORDER BY 1 + 3 * regexp_matches(lower(s), '\b({EVENT_VERBS})\b')::INT + regexp_matches(lower(s), '\b({CAUSAL})\b')::INT DESC, pos) AS k FROM nm JOIN s ON s.doc_id = nm.doc_id AND s.chapter = nm.chapter AND contains(lower(s), lower(n))), g AS (SELECT doc_id, chapter, n, string_agg(a, '|' ORDER BY k) AS actions FROM h WHERE k <= 3 GROUP BY doc_id, chapter, n) SELECT nm.doc_id, nm.n AS name, nm.chapter, ((length(text) - length(replace(text, nm.n, ''))) // length(nm.n))::INT AS mentions, coalesce(actions, '{NO_ACTION}') AS actions FROM nm LEFT JOIN g ON g.doc_id = nm.doc_id AND g.chapter = nm.chapter AND g.n = nm.n WHERE nm.n IN ('John', 'Mary', 'Dawn', 'Still')",
}
