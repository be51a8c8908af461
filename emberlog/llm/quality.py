"""Quality rules by distribution divergence, in DataFrame functions only.

Every text is described by two histograms: of character classes and of common function words.  Each language's reference is
the sum of the histograms of all its documents, in which a document weighs at most ``MAX_WEIGHT`` characters or words, and of
which the judged document itself is left out; a text is rejected when the Jensen-Shannon distance between its histogram and
that reference is too large.  Short texts have noisy histograms, so a comparison needs a least number of characters or words,
and what is too large for the words falls with the root of their number, as sampling noise does.  Base rules on length and on
repeated word windows come first.

A document that has no other of its reference is not compared.  Nulls: a null text has no words and fails the base rules; an unknown or null language is compared with the pooled reference
of all such documents.  Equal rows are judged alike.  An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import cut, text_or_empty

#: Languages with a reference of their own, and their common words (Spanish, German, English, French).
LANGUAGES = ("de", "en", "es", "fr")
COMMON_WORDS = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an er".split(),
    "en": "the of and to in a is that for it was on with as be by at this from are or an which have".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce".split(),
}
#: Character classes, frequent ones first; what is in none of them is "other".
CHARACTER_CLASSES = {
    "consonant": "bcdfghjklmnpqrstvwxyz",
    "vowel": "aeiou",
    "space": " \t\n\v\f\r",
    "stop": ".,;:!?",
    "capital": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "symbol": "#*$%&|<>",
    "digit": "0123456789",
    "bracket": "()[]{}\"'/\\-_=+@~^`",
}
#: What separates words.
SPACES = r"[\x20\x09-\x0D]+"
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
#: Least size for a comparison, and the distance beyond which a text is rejected: by characters alone (0 to 1), and by the
#: sum of both distances (0 to 2), which needs enough words.
MIN_CHARS, MAX_CHAR_DISTANCE = 200, 0.3
MIN_COMMON_WORDS, MAX_BOTH_DISTANCES = 60, 0.48
#: The distance of the words alone beyond which a text is rejected: a margin, and 1.25 times the noise of a text of n words,
#: which is sqrt(27 / (8 n ln 2)), about 2.2 / sqrt(n), for the 28 or so common words that a language uses.
WORD_MARGIN, WORD_NOISE = 0.08, 2.75
#: Characters and words with which one document counts in its reference, at most.
MAX_WEIGHT = 2_000

VOCABULARY = sorted({w for words in COMMON_WORDS.values() for w in words})
#: What may follow a word, and a character that stands for each common word.
PUNCTUATION = ".,;:!?"
MARKS = [chr(ord("!") + k) for k in range(len(VOCABULARY))]


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def count_of(text: Column, characters: str) -> Column:
    """How many characters of ``text`` are among ``characters``."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows of ``window`` words that occur twice or more in the array; long.

    Hashes of the windows show which texts have no repeat at all, and in the rest which windows are compared by their words.
    """

    def again(found: Column) -> Column:
        """Of (key, place) in order those whose key has a neighbour's value."""

        def beside(x: Column, k: Column) -> Column:  # k counts from 0
            before = (k > 0) & (F.get(found, k - 1)["s"] == x["s"])
            return before | ((k < F.size(found) - 1) & (F.get(found, k + 1)["s"] == x["s"]))

        return F.filter(found, beside)

    def covered(w: Column, h: Column) -> Column:
        hashed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("s"), (i + 0).alias("i"))))

        def spelled(some: Column) -> Column:  # equal hashes are looked at, so only equal windows count
            text = lambda x: F.concat_ws(" ", *(F.get(w, x["i"] + k) for k in range(window)))
            return F.array_sort(F.transform(some, lambda x: F.struct(text(x).alias("s"), x["i"].alias("i"))))

        places = let(let(let(hashed, again), spelled), lambda s: F.array_sort(F.transform(again(s), lambda x: x["i"])))

        def length(at: Column) -> Column:
            gaps = F.aggregate(at, F.struct(F.lit(0).alias("n"), F.lit(-window).alias("end")), lambda a, x: F.struct((a["n"] + F.least(F.lit(window), x - a["end"])).alias("n"), x.alias("end")))
            return F.when(F.size(at) > 0, gaps["n"]).otherwise(0)

        return let(places, length)

    def hashes(w: Column) -> Column:
        beside = F.arrays_zip(w, *(F.slice(w, F.lit(k), F.greatest(F.size(w), F.lit(1))) for k in range(2, window + 1)))
        return F.transform(F.slice(beside, F.lit(1), F.size(w) - (window - 1)), lambda words: F.xxhash64(words))

    def count(w: Column) -> Column:
        found = let(hashes(w), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(w, h)))
        return F.when(F.size(w) <= window, 0).otherwise(found).cast("long")

    return let(words, count)


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line; long."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def character_counts(text: Column, classes: tuple[str, ...] = tuple(CHARACTER_CLASSES.values())) -> Column:
    """Characters of each class, then the rest.  Each class is taken out of what the earlier ones left, which is soon little."""
    if not classes:
        return F.array(F.length(text).cast("long"))
    rest = F.translate(text, classes[0], "")
    return let(rest, lambda r: F.concat(F.array((F.length(text) - F.length(r)).cast("long")), character_counts(r, classes[1:])))


def common_word_counts(words: Column) -> Column:
    """One string with a mark for each common word of the text: a histogram that takes a single pass.

    Punctuation after a word is no part of it; a long word is only looked at where it may end with more than one such character.
    """
    marks = F.create_map(*(F.lit(x) for w, mark in zip(VOCABULARY, MARKS, strict=True) for x in (w, mark)))
    longest = max(map(len, VOCABULARY))
    short = F.filter(words, lambda w: (F.length(w) <= longest + 1) | F.substring(w, -2, 1).isin(*PUNCTUATION))
    common = F.filter(F.transform(short, lambda w: F.rtrim(F.lower(w), F.lit(PUNCTUATION))), lambda w: w.isin(VOCABULARY))
    return F.array_join(F.transform(common, lambda w: F.element_at(marks, w)), "")


def histogram_columns(docs: DataFrame) -> DataFrame:
    """(doc_id, reference, n_words, base counts, chars, common): the histograms are arrays of longs, the last bin is the rest."""
    text = F.col("__text")
    rows = docs.select(F.col("doc_id"), F.coalesce(F.when(F.col("lang").isin(*LANGUAGES), F.col("lang")), F.lit("other")).alias("reference"), text_or_empty().alias("__text"))
    trimmed = F.btrim(text, F.lit(CHARACTER_CLASSES["space"]))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES))

    def measured(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"), common_word_counts(w).alias("letters"))

    rows = rows.select(
        "doc_id",
        "reference",
        let(words, measured).alias("w"),
        duplicate_lines(text).alias("n_dup_lines"),
        let(text, lambda t: character_counts(t)).alias("chars"),
    )
    classes = list(CHARACTER_CLASSES)
    everything = F.aggregate("chars", F.lit(0).cast("long"), lambda a, x: a + x)
    letters = F.col("w")["letters"]
    common = [(F.length(letters) - F.length(F.replace(letters, F.lit(m), F.lit("")))).cast("long") for m in MARKS]
    return rows.select(
        "doc_id",
        "reference",
        F.col("w")["n_words"].alias("n_words"),
        (everything - F.col("chars")[classes.index("space")]).alias("word_chars"),
        F.col("chars")[classes.index("symbol")].alias("n_symbols"),
        "n_dup_lines",
        F.col("w")["n_repeat_words"].alias("n_repeat_words"),
        "chars",
        F.array(*common, F.col("w")["n_words"] - F.length(letters)).alias("common"),
    )


def weighed(histogram: Column) -> Column:
    """A document's part of its reference: its counts, scaled down (to whole numbers) where they are more than ``MAX_WEIGHT``."""
    return let(F.aggregate(histogram, F.lit(0).cast("long"), lambda a, x: a + x), lambda n: F.when(n <= MAX_WEIGHT, histogram).otherwise(F.transform(histogram, lambda x: F.floor(x * MAX_WEIGHT / n).cast("long"))))


def references(rows: DataFrame) -> DataFrame:
    """(reference, ref_chars, ref_common): sums over all documents; at most one row per language named in LANGUAGES and one."""
    rows = rows.select("reference", weighed(F.col("chars")).alias("chars"), weighed(F.col("common")).alias("common"))
    sums = {name: [F.sum(F.col(name)[k]) for k in range(n)] for name, n in (("chars", len(CHARACTER_CLASSES) + 1), ("common", len(VOCABULARY) + 1))}
    return rows.groupBy("reference").agg(*(F.array(*s).alias(f"ref_{name}") for name, s in sums.items()))


def jensen_shannon(p: Column, q: Column) -> Column:
    """The distance (square root of the divergence, base 2) between two histograms; 0 where one is empty."""

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda a, y: a + y)

    def term(a: Column, m: Column) -> Column:
        return F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)

    def divergence(a: Column, b: Column) -> Column:
        return total(F.zip_with(a, b, lambda x, y: term(x, (x + y) / 2) + term(y, (x + y) / 2))) / 2

    def scaled(x: Column) -> Column:
        return let(total(x), lambda n: F.transform(x, lambda y: y / n))

    some = (total(p) > 0) & (total(q) > 0)
    return F.when(some, F.sqrt(F.greatest(F.lit(0.0), let(scaled(p), lambda a: let(scaled(q), lambda b: divergence(a, b)))))).otherwise(0.0)


def judge(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, char_distance,
    word_distance) for ``docs`` (doc_id, text, lang)."""
    rows = cut(histogram_columns(docs))
    joined = rows.join(F.broadcast(references(rows)), "reference")
    enough_chars = F.col("word_chars") >= MIN_CHARS
    enough_words = F.col("n_words") >= MIN_COMMON_WORDS

    def distance(name: str) -> Column:
        others = F.zip_with(F.col(f"ref_{name}"), weighed(F.col(name)), lambda all_, own: all_ - own)
        return jensen_shannon(F.col(name), others)

    joined = joined.withColumns({"char_distance": distance("chars"), "word_distance": distance("common")})
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    word_limit = WORD_MARGIN + WORD_NOISE / F.sqrt(F.greatest(F.col("n_words"), F.lit(1)))
    far = enough_chars & (F.col("char_distance") > MAX_CHAR_DISTANCE)
    far = far | (enough_words & ((F.col("char_distance") + F.col("word_distance") > MAX_BOTH_DISTANCES) | (F.col("word_distance") > word_limit)))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~far).alias("kept"), "char_distance", "word_distance")
