"""Quality rules by distribution divergence, in DataFrame functions only.

Each document's histogram of character classes and of common words is compared with the
references of the corpus' languages by Jensen-Shannon distance (the square root of the
divergence in bits, 0 to 1). A reference is the sum of the histograms of all documents of one
`lang`; a document is held against the nearest one, so a wrong or missing `lang` does not
count against it. It passes if both distances are within their limits; a distance counts only
for documents of a minimum length (``min_chars`` characters in words, ``min_words`` words).

Base counts: characters in words, symbols, lines equal to an earlier line, words in 8-word
windows that occur twice or more; a document fails the base with fewer than 20 words or with
more than 30 % of its words in repeated windows.

Texts are read once: counts go to a narrow table in the shared folder, references (a small
table with a row for each language) are sums of it. Documents are compared with ``block``
references at a time, the bound on what reaches the driver; with more languages each block is
a pass over the counts that keeps the least distance so far.

Defined cases: null, empty and wordless texts have zero counts and fail the base; a corpus
without references passes every document that the base passes; repeated rows are judged alike
(each counts in the reference); very long texts are whole; further columns are ignored.
"""

from __future__ import annotations

from itertools import islice

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odonymy.session import discard, materialize

# Frequent function words of English, German, French and Spanish.
COMMON = ["the", "of", "and", "to", "in", "is", "that", "for", "der", "die", "und", "das", "den", "mit", "von", "zu", "le", "la", "les", "et", "des", "est", "en", "que", "el", "los", "de", "y", "con", "por", "se", "del"]
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"[: len(COMMON)]
SPACES = r"[\x20\x09-\x0D]+"
#: What each character class keeps of a text; letters and all else are the rest.
CLASSES = {"upper": r"[^\p{Lu}]+", "digit": r"[^\p{Nd}]+", "symbol": r"[^#*$%&|<>]+", "mark": r"[^!\"'()+,\-./:;=?@\[\\\]^_`{}~]+"}
WINDOW = 8
CHAR_LIMIT, WORD_LIMIT = 0.25, 0.25
#: Histograms and their numbers of bins.
WIDTHS = {"chars": 2 + len(CLASSES), "common": 1 + len(COMMON)}


def counts(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, lang, base counts, chars and common (histograms as arrays)."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), text.alias("text"))
    kept = {k: F.length(F.regexp_replace("text", p, "")) for k, p in CLASSES.items()}
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select("doc_id", "lang", F.filter(F.split("text", SPACES), lambda x: x != "").alias("w"), lines.alias("lines"), F.length("text").alias("all"), F.length(F.regexp_replace("text", SPACES, "")).alias("word_chars"), *(v.alias(k) for k, v in kept.items()))
    # Each common word's place in the list as a letter: a word costs one look-up, a list entry one pass
    # over a short string.
    letter = lambda x: F.substring(F.lit(LETTERS), F.find_in_set(x, F.lit(",".join(COMMON))), F.lit(1))
    codes = F.array_join(F.transform(F.filter("w", lambda x: x.isin(*COMMON)), letter), "")
    rows = rows.select("doc_id", "lang", F.size("w").alias("n_words"), "word_chars", "all", *CLASSES, (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"), codes.alias("codes"), F.transform("w", lambda x: F.xxhash64(x)).alias("w"))
    # Hashes of two words, of four, of eight; those beyond the end are left out at last.
    for k in (1, 2, 4):
        rows = rows.withColumn("w", _joined("w", k))
    n = F.col("n_words")
    common = [F.length("codes") - F.length(F.replace("codes", F.lit(c), F.lit(""))) for c in LETTERS]
    windows = F.when(n >= WINDOW, F.slice("w", F.lit(1), n - (WINDOW - 1))).otherwise(F.expr("cast(array() as array<bigint>)"))
    rows = rows.select("doc_id", "lang", "n_words", "word_chars", "all", *CLASSES, "n_dup_lines", F.array(*common).alias("known"), windows.alias("win"))
    # Only texts with a repeated window are sorted.
    pairs = F.array_sort(F.transform("win", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    rows = rows.withColumn("s", F.when(F.size(F.array_distinct("win")) < F.size("win"), pairs)).drop("win")
    again = F.filter(F.transform("s", lambda e, j: F.when((e["h"] == F.get("s", j - 1)["h"]) | (e["h"] == F.get("s", j + 1)["h"]), e["p"])), lambda p: p.isNotNull())
    rows = rows.withColumn("at", F.when(F.col("s").isNotNull(), F.sort_array(again))).drop("s")
    covered = F.aggregate(F.transform("at", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get("at", j + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    rest = F.col("word_chars") - sum((F.col(k) for k in CLASSES), F.lit(0))
    known_sum = F.aggregate("known", F.lit(0), lambda a, x: a + x)
    as_long = lambda name: F.col(name).cast("long").alias(name)
    rows = rows.select(
        "doc_id", "lang", as_long("n_words"), as_long("word_chars"), F.col("symbol").cast("long").alias("n_symbols"), as_long("n_dup_lines"), F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.array(rest.cast("double"), (F.col("all") - F.col("word_chars")).cast("double"), *(F.col(k).cast("double") for k in CLASSES)).alias("chars"),
        F.concat(F.array((F.col("n_words") - known_sum).cast("double")), F.transform("known", lambda x: x.cast("double"))).alias("common"),
    )
    return rows.select("*", _share("chars").alias("chars_share"), _share("common").alias("common_share"))


def _joined(column: str, k: int) -> Column:
    """Each hash of a list with the one k places on."""
    return F.transform(column, lambda x, i: F.xxhash64(x, F.get(column, i + k)))


def _share(column: str) -> Column:
    """A count array as shares; null if all are zero."""
    total = F.aggregate(column, F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, F.transform(column, lambda x: x / total))


def references(counted: DataFrame) -> DataFrame:
    """A row for each language: shares of its bins from all its documents (null if all are zero)."""
    sums = [F.sum(F.get(column, F.lit(i))).alias(f"{column}{i}") for column, width in WIDTHS.items() for i in range(width)]
    rows = counted.where("lang is not null").groupBy("lang").agg(*sums)
    rows = rows.select("lang", *(F.array(*(f"{column}{i}" for i in range(width))).alias(column) for column, width in WIDTHS.items()))
    return rows.select("lang", *(_share(column).alias(column) for column in WIDTHS))


def distance(column: str, refs: list[list[float]]) -> Column:
    """Least Jensen-Shannon distance of an array of shares to the references; null without any."""

    def term(p: Column, q: Column) -> Column:
        m = (p + q) / 2
        part = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
        return (part(p) + part(q)) / 2

    if not refs:
        return F.lit(None).cast("double")
    literal = F.array(*(F.array(*map(F.lit, r)) for r in refs))
    each = F.transform(literal, lambda r: F.aggregate(F.zip_with(column, r, term), F.lit(0.0), lambda a, x: a + x))
    return F.when(F.col(column).isNotNull(), F.sqrt(F.greatest(F.array_min(each), F.lit(0.0))))


def nearest(counted: DataFrame, block: int) -> DataFrame:
    """``counted`` with its least distances to all references, ``block`` of them at a time."""
    none = F.lit(None).cast("double")
    rows = counted.drop(*WIDTHS).withColumns({"char_distance": none, "word_distance": none})
    refs = materialize(references(counted), "rule-references")
    left, old = refs.toLocalIterator(), counted
    part = list(islice(left, block))
    while part:
        char, word = (distance(f"{column}_share", [row[column] for row in part if row[column]]) for column in WIDTHS)
        rows = rows.withColumns({"char_distance": F.least("char_distance", char), "word_distance": F.least("word_distance", word)})
        part = list(islice(left, block))
        if part:
            rows = materialize(rows, "rule-distances")
            discard(old)
            old = rows
    discard(refs)
    return rows


def judge(docs: DataFrame, min_chars: int = 100, min_words: int = 50, block: int = 200) -> DataFrame:
    """Base counts, both distances, base_failed and kept of every document."""
    counted = nearest(materialize(counts(docs), "rule-counts"), block)
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = counted.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "char_distance", "word_distance")
    far = ((F.col("word_chars") >= min_chars) & (F.col("char_distance") > CHAR_LIMIT)) | ((F.col("n_words") >= min_words) & (F.col("word_distance") > WORD_LIMIT))
    return rows.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(far, F.lit(False)))


def digest(judged: DataFrame) -> DataFrame:
    """The columns of query op10."""
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
