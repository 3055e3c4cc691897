"""Column functions for words, sentences, blanks and n-grams; all JVM-side.

Arrays made by long expressions are unnested by the outer forms of explode: from the inner ones the optimiser infers a filter on the
array's size, pushes it below the projections and so writes the whole expression out a second time, names replaced by what they stand for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks of ASCII regular expressions, and white space by Unicode; Java's own classes differ from both.
BLANK = r"[\t\n\f\r ]"
WIDE = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: The same white space as characters.
SPACES = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Where a word of ASCII word characters begins, before its first, and where it ends, behind its last; cheaper than EDGE.
BEGIN, END = "(?<![0-9A-Za-z_])", "(?![0-9A-Za-z_])"
#: A word boundary by ASCII word characters.
EDGE = r"(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))"


def find_all(t: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(t, F.lit(pattern), F.lit(group))


def count_all(t: Column, pattern: str) -> Column:
    return F.size(find_all(t, pattern))


def trimmed(t: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(t, F.lit(SPACES))


def fields(t: Column) -> Column:
    """Pieces between white space."""
    return F.filter(F.split(t, f"{WIDE}+"), lambda x: x != "")


def prose_words(t: Column) -> Column:
    """Lower-case runs of letters and apostrophes."""
    return find_all(F.lower(t), "[a-z']+")


def detector_words(normal: Column) -> Column:
    """Words of a text that normal_text() has made."""
    return find_all(normal, "[a-z0-9']+")


def lines_tidied(t: Column) -> Column:
    """Lines trimmed, inner white space as one blank, empty lines dropped."""
    tidy = F.transform(F.split(t, "\n"), lambda x: F.array_join(fields(x), " "))
    return F.array_join(F.filter(tidy, lambda x: x != ""), "\n")


def normal_text(t: Column) -> Column:
    """Lower case, with only a-z, 0-9, . ? ! and blanks; line ends stay."""
    t = F.lower(F.replace(F.replace(t, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")))
    t = F.regexp_replace(t, r"[^a-z0-9\t\n\f\r .?!]+", " ")
    return F.regexp_replace(F.regexp_replace(t, rf"^{BLANK}+|{BLANK}+\z", ""), r"[ \t]+", " ")


def normal_block(t: Column) -> Column:
    """Lower-case a-z and 0-9 with single blanks."""
    return F.trim(F.regexp_replace(F.lower(t), "[^a-z0-9]+", " "))


def split_sentences(t: Column) -> Column:
    """What stands between runs of . ! ?, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(t, "[.!?]+"), trimmed), lambda x: x != "")


def sentence_words(t: Column) -> Column:
    """prose_words() of each of split_sentences(), which need no trimming for it; flattened they are those of the text, for no word holds an end mark."""
    return F.transform(F.filter(F.split(t, "[.!?]+"), lambda x: x.rlike(WIDE.replace("[", "[^", 1))), prose_words)


def kept_sentences(t: Column) -> Column:
    """Sentences with their first end mark."""
    return F.filter(F.transform(find_all(t, "[^.!?]+[.!?]?"), trimmed), lambda x: x != "")


def first_words(t: Column, n: int) -> Column:
    """The first n fields(); what follows them is not cut up."""
    return F.array_join(F.slice(F.filter(F.split(t, f"{WIDE}+", n + 2), lambda x: x != ""), 1, n), " ")


def substring_count(t: Column, needle: str) -> Column:
    """Occurrences that do not overlap."""
    return ((F.length(t) - F.length(F.replace(t, F.lit(needle)))) / len(needle)).cast("int")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once although body names it often."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def gram_hash(words: list[Column]) -> Column:
    """The 64-bit hash of one run of words that gram_hashes() gives it."""
    hashes = [F.xxhash64(w) for w in words]
    done, at, step = None, 0, 1
    parts = hashes
    while step <= len(words):
        if len(words) & step:
            done = parts[at] if done is None else F.xxhash64(done, parts[at])
            at += step
        parts = [F.xxhash64(parts[i], parts[i + step]) for i in range(len(parts) - step)]
        step *= 2
    return done


def gram_hashes(words: Column, n: int) -> Column:
    """A hash of every run of n words, in order; none if there are fewer words.

    Words are hashed once; hashes of runs of 1, 2, 4 ... words make those of n, so no run is ever built.
    """
    later = lambda a, k: F.slice(a, k + 1, F.greatest(F.size(a) - k, F.lit(0)))
    joined = lambda a, b: F.zip_with(a, b, lambda x, y: F.xxhash64(x, y))

    def go(parts: Column, done: Column | None, at: int, step: int) -> Column:
        if n & step:
            own = later(parts, at)
            done, at = own if done is None else joined(done, own), at + step
        if step * 2 > n:
            return done
        held = done if done is not None else F.array().cast("array<bigint>")
        twice = lambda c: F.struct(joined(c["p"], later(c["p"], step)).alias("p"), c["d"].alias("d"))
        some = done is not None
        return let(let(F.struct(parts.alias("p"), held.alias("d")), twice), lambda c: go(c["p"], c["d"] if some else None, at, step * 2))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    count = F.greatest(F.size(words) - n + 1, F.lit(0))
    return F.slice(let(hashes, lambda h: go(h, None, 0, 1)), F.lit(1), count)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def sd_and_mean(values: Column) -> tuple[Column, Column]:
    """Population deviation and mean of an array of numbers; 0 where it is empty. The deviation goes by Welford's steps in the array's order, as SQL's stddev_pop does, so that ties at a limit fall as there. One pass each, for a lambda runs per element."""
    zero = F.lit(0.0)
    state = lambda n, mean, squares: F.struct(n.alias("n"), mean.alias("mean"), squares.alias("squares"))

    def step(a: Column, x: Column) -> Column:
        n = a["n"] + 1.0
        mean = a["mean"] + (x - a["mean"]) / n
        return state(n, mean, a["squares"] + (x - mean) * (x - a["mean"]))

    deviation = F.aggregate(values, state(zero, zero, zero), step, lambda a: F.sqrt(a["squares"] / F.greatest(a["n"], F.lit(1.0))))
    total = F.aggregate(values, zero, lambda a, x: a + x)
    return deviation, total / F.greatest(F.size(values), F.lit(1))


def starts(n: Column, size: int, step: int) -> Column:
    """Where windows of `size` over n items begin: every `step`, up to the first that reaches the end."""
    count = F.when(n <= size, F.lit(1)).otherwise(F.ceil((n - size) / F.lit(float(step))).cast("int") + 1)
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: i * step)
