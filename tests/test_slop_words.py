"""The slop report reads a text's words once; what it leaves out makes no difference to its figures."""

from quillmill.functions import text as T
from quillmill.operators import slop

ODD = [
    "", " ", "...", "One. 　 . two!  ?\x85 Three's; 'four'", "İstanbul İ. Aİa B.  . \x0b\x1c. c",
    "\n\n".join([" ".join(["İ"] * 40)] * 2 + ["a " * 35, "a-- " * 35, "a " * 34]), "\n \n\n".join(["-- One, two. " * 20, "one two " * 20, "ONE  TWO\n" * 20]), "x\n\n" + "it was a " * 30, "at the same time it was a", "one of", "--  !a! \t b--",
]


def test_words_of_sentences_are_those_of_the_text(spark):
    rows = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    t = rows["text"]
    got = rows.select(T.sentence_words(t).alias("own"), T.F.transform(T.split_sentences(t), T.prose_words).alias("plain"), T.F.flatten(T.sentence_words(t)).alias("all"), T.prose_words(t).alias("words"), T.normal_block(t).alias("key"), "text").collect()
    assert all(r.own == r.plain and r.all == r.words for r in got)
    plain = lambda x: " ".join("".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in x.lower()).split())
    assert [r.key for r in got] == [plain(x) for x in ODD]


def test_blocks_and_trigrams_of_odd_texts(spark):
    rows = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    got = rows.select(slop.repeated_blocks(rows["text"]).alias("r"), slop.common_trigrams(T.prose_words(rows["text"])).alias("share")).collect()
    assert [tuple(r.r) for r in got[:5]] == [(0, 0, 0)] * 5 and tuple(got[5].r) == (150, 2, 2) and tuple(got[6].r) == (120, 1, 3)
    assert got[7].share == 30 / 89 and got[8].share == 2 / 5 and got[9].share == 0


def test_words_are_taken_once_beside_paragraphs(spark):
    rows = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = slop.slop(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[a-z']+, 0)") == 2  # of sentences, and of paragraphs where two are long; three before
