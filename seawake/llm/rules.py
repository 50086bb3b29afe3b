"""Quality rules by distribution divergence, in DataFrame expressions only.

A document's histogram of character classes and its histogram of common words
(each common word, and all others) are compared with the references of its
language by Jensen-Shannon distance (base 2, 0 to 1). References are mean
histograms over the corpus: first over all documents that pass the base rules,
then over those of them within NEAR of the first, if there are any. Every language has a reference
of its own, however many there are; a null lang is a language too, as in SQL's GROUP BY.

A document fails when it is long enough for the comparison (MIN_CHARS, MIN_WORDS)
and its distance exceeds the limit, and when the base rules fail: under 50
words, or over half of them in three-word windows that occur twice or more.

Windows are found repeated by sorting one long per window, a hash above the
window's position, and comparing the hashes of the words of neighbours. Null text has no words and fails; a null or repeated doc_id keeps its
row. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import small_batches, written

# The commonest words of English, French, German and Spanish.
COMMON_WORDS = (
    "the of and to in a is that for it "
    "de la le les des et un une du que pour "
    "der die und das den mit von zu ist nicht "
    "el los las y en por con del"
).split()
CHAR_LIMIT, WORD_LIMIT, NEAR = 0.18, 0.45, 0.15
MIN_CHARS, MIN_WORDS = 100, 50
#: References of so many languages are broadcast; above that Spark chooses the join.
BROADCAST_LANGUAGES = 4096
#: What is taken from a text in turn; each class counts what its pattern removes, the last what is left.
CLASSES = ("[a-z]+", "[A-Z]+", "[0-9]+", "[ \\t\\n\\x0B\\f\\r]+", "[.,;:!?'\"()\\-]+", "[\\x00-\\x7F]+")
_GAP = "[ \\t\\n\\x0B\\f\\r]+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once."""
    return F.transform(F.array(value), use)[0]


def repeated_words(words: Column, n: Column) -> Column:
    """Words in three-word windows that occur twice or more."""

    def marked(hashes: Column) -> Column:
        low = F.call_function("shiftleft", F.lit(1).cast("long"), F.ceil(F.log2(n + F.lit(1))).cast("int")) - F.lit(1)

        def with_mask(mask: Column) -> Column:
            windows = F.transform(F.sequence(F.lit(0), n - F.lit(3)), lambda i: F.xxhash64(hashes[i], hashes[i + 1], hashes[i + 2]).bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i.cast("long")))
            return let(F.sort_array(windows), lambda s: covered(s, mask, hashes))

        return let(low, with_mask)

    def covered(s: Column, mask: Column, hashes: Column) -> Column:
        same = lambda x, y: x.bitwiseXOR(y) <= mask
        at = lambda x, j: F.get(hashes, x.bitwiseAND(mask).cast("int") + j)
        # The longer the text, the fewer bits of a window's hash are left: its words' own hashes decide.
        near = lambda x, y: same(x, y) & (x.bitwiseXOR(y) >= 0) & (at(x, 0) == at(y, 0)) & (at(x, 1) == at(y, 1)) & (at(x, 2) == at(y, 2))
        twice = F.filter(s, lambda x, i: F.when(i > 0, near(x, F.get(s, i - 1))).otherwise(False) | F.coalesce(near(x, F.get(s, i + 1)), F.lit(False)))
        places = F.sort_array(F.transform(twice, lambda x: x.bitwiseAND(mask)))
        return let(places, lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get(p, i + 1) - x, F.lit(3).cast("long")))), F.lit(0).cast("long"), lambda a, x: a + x))

    return F.when(n < 3, F.lit(0).cast("long")).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), marked))


def js_distance(counts: Column, total: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of counts / total and a reference distribution."""

    def part(p: Column, m: Column) -> Column:
        return F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0))

    terms = F.zip_with(counts, reference, lambda c, q: let(c / total, lambda p: part(p, (p + q) / 2) + part(q, (p + q) / 2)))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, n_words, the base columns, base_failed, n_chars, chars and commons (histograms) of every row."""
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang") if "lang" in docs.columns else F.lit(None).cast("string").alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    df = df.withColumn("words", F.array_remove(F.split("text", _GAP, -1), "")).withColumn("r0", F.col("text"))
    for i, pattern in enumerate(CLASSES):
        df = df.withColumn(f"r{i + 1}", F.regexp_replace(f"r{i}", pattern, ""))
    size = lambda i: F.length(f"r{i}").cast("long")
    chars = F.array(*(size(i) - size(i + 1) for i in range(len(CLASSES))), size(len(CLASSES)))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike("[^ \\t\\n\\x0B\\f\\r]"))
    both = [v for w in COMMON_WORDS for v in dict.fromkeys((w, w.capitalize(), w.upper()))]
    common = F.transform(F.filter("words", lambda w: w.isin(both)), lambda w: F.lower(w))
    df = df.select("doc_id", "lang", "text", "words", chars.alias("chars"), F.size("words").alias("n"), lines.alias("lines"), common.alias("common"), F.length(F.regexp_replace("text", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"))
    hits = [F.size("common") - F.size(F.array_remove("common", w)) for w in COMMON_WORDS]
    df = df.select(
        "doc_id",
        "lang",
        F.col("n").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words"), F.col("n")).alias("n_repeat_words"),
        "chars",
        F.array(*(h.cast("long") for h in hits), (F.col("n") - F.size("common")).cast("long")).alias("commons"),
    )
    df = df.withColumn("n_chars", F.aggregate("chars", F.lit(0).cast("long"), lambda a, x: a + x))
    return df.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _references(rows: DataFrame) -> DataFrame:
    """lang, char_reference, word_reference: mean histograms of each language (null is one)."""

    def means(column: str, total: str, n: int) -> list[Column]:
        return [F.avg(F.col(column)[i] / F.col(total)) for i in range(n)]

    chars, words = means("chars", "n_chars", len(CLASSES) + 1), means("commons", "n_words", len(COMMON_WORDS) + 1)
    return rows.groupBy("lang").agg(F.array(*chars).alias("char_reference"), F.array(*words).alias("word_reference"))


def _compared(rows: DataFrame, references: DataFrame) -> DataFrame:
    of = references.select(F.col("lang").alias("_lang"), "char_reference", "word_reference")
    few = len(of.select("_lang").take(BROADCAST_LANGUAGES + 1)) <= BROADCAST_LANGUAGES
    met = rows.join(F.broadcast(of) if few else of, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    distance = lambda counts, total, reference: F.when((F.col(total) > 0) & F.col(reference).isNotNull(), js_distance(F.col(counts), F.col(total), F.col(reference)))
    return met.withColumn("char_distance", distance("chars", "n_chars", "char_reference")).withColumn("word_distance", distance("commons", "n_words", "word_reference")).drop("_lang", "char_reference", "word_reference")


def quality_rules(docs: DataFrame, char_limit: float = CHAR_LIMIT, word_limit: float = WORD_LIMIT, min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, char_distance, word_distance."""
    small_batches(docs.sparkSession)
    rows = written(measured(docs), "measured")
    passed = rows.where("NOT base_failed")
    first = written(_references(passed), "references")
    near = _compared(passed, first).where(F.col("char_distance") <= NEAR)
    second = written(_references(near), "references")
    kept_first = first.join(second.select(F.col("lang").alias("_lang")), F.col("lang").eqNullSafe(F.col("_lang")), "left_anti")
    out = _compared(rows, second.union(kept_first))
    far = ((F.col("n_chars") >= min_chars) & (F.col("char_distance") > char_limit)) | ((F.col("n_words") >= min_words) & (F.col("word_distance") > word_limit))
    kept = ~F.col("base_failed") & ~F.coalesce(far, F.lit(False))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.round("char_distance", 6).alias("char_distance"), F.round("word_distance", 6).alias("word_distance"))
