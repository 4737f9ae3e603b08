"""Quality rules: counts of a text, and its divergence from its language.

A text's histogram of character classes and its histogram of the language's
common words are compared with the language's own by Jensen-Shannon distance.
Everything is built-in Spark functions; the references are aggregates over all
documents, a row a language.

Windows are compared by 64-bit hashes within a text: of a text of a million
words two different windows agree with a chance of about 3 in 100 million.

Defined cases: a null text has no words; texts under ``MIN_WORDS`` words, and
texts whose language is null or has under ``MIN_REFERENCE`` words in all, get
no verdict from a distance (the base rules alone decide); repeated rows are
judged each, texts of any length whole; words that are equally frequent are
taken in their order; an empty table gives no row.  The result has the columns
of the table and those of ``JUDGED``, which take the place of columns of such a
name; a table's other columns keep their values, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

COMMON = 32
#: Words are looked up among the common ones of all languages first while those are no more than this.
LOOKED_UP = 2_048
MIN_WORDS, MIN_REFERENCE = 50, 2_000
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.28, 0.38

#: Columns that the rules add.
JUDGED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", "kept")

#: Classes of characters in words, taken off one after the other; what is left is the last class.
CLASSES = ("[a-z]+", "[A-Z]+", "[0-9]+", r"[.,;:!?'\"()-]+", r"[\x00-\x7f]+")


def with_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``_words``: runs outside white space; ``_chars``: their characters."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumn("_words", F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")).withColumn("_chars", F.array_join("_words", ""))


def with_classes(df: DataFrame) -> DataFrame:
    """``_classes``: how many characters of the words each class has."""
    left = [F.col("_chars")]
    for k, pattern in enumerate(CLASSES):
        df = df.withColumn(f"_left{k}", F.regexp_replace(left[-1], pattern, ""))
        left.append(F.col(f"_left{k}"))
    counts = [F.length(a) - F.length(b) for a, b in zip(left, left[1:])] + [F.length(left[-1])]
    return df.withColumn("_classes", F.array(*[c.cast("long") for c in counts])).drop(*[f"_left{k}" for k in range(len(CLASSES))])


def repeated_window_words(words: str = "_words") -> Column:
    """Words in 3-word windows that the text has twice or more.

    A text whose windows' hashes are all distinct has none.  In others, windows
    are sorted by hash; those that equal a neighbour are repeated.  With their
    places in order, each adds the words that the one before didn't cover.
    """
    windows = f"arrays_zip(slice({words}, 1, size({words}) - 2), slice({words}, 2, size({words}) - 2), slice({words}, 3, size({words}) - 2))"
    return F.expr(
        f"""
        CASE WHEN size({words}) < 4 THEN 0L ELSE
        transform(array(transform({windows}, x -> xxhash64(x))), hs ->
          CASE WHEN size(array_distinct(hs)) = size(hs) THEN 0L ELSE
          aggregate(
            sort_array(transform(
              transform(array(sort_array(transform(hs, (h, i) -> struct(h, i)))),
                s -> filter(s, (x, k) -> (k > 0 AND s[k - 1].h = x.h) OR (k + 1 < size(s) AND s[k + 1].h = x.h)))[0],
              x -> x.i)),
            struct(0L AS n, -3 AS last),
            (a, i) -> struct(a.n + least(3, i - a.last) AS n, i AS last),
            a -> a.n) END)[0] END
        """
    )


def base_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed; needs ``with_words``."""
    lines = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return (
        df.withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("word_chars", F.length("_chars").cast("long"))
        .withColumn("n_symbols", (F.length("_chars") - F.length(F.regexp_replace("_chars", "[#*$%&|<>]+", ""))).cast("long"))
        .withColumn("_lines", lines)
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("n_repeat_words", repeated_window_words())
        .withColumn("base_failed", (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words")))
        .drop("_lines")
    )


def language_references(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """A row for each language of ``MIN_REFERENCE`` words or more: (lang, common, word_share, class_share).

    ``common`` has the most frequent words.  Counted over all documents, with
    partial aggregates before each shuffle.
    """
    rows = with_words(docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter(F.col("lang").isNotNull()))
    classes = with_classes(rows).groupBy("lang").agg(
        F.sum(F.size("_words").cast("long")).alias("words"),
        *[F.sum(F.col("_classes")[k]).alias(f"c{k}") for k in range(len(CLASSES) + 1)],
    )
    counted = rows.select("lang", F.explode("_words").alias("word")).groupBy("lang", "word").count()
    # Each task cuts its part to COMMON rows a language before they are shuffled.
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "word"))
    top = counted.withColumn("k", first).filter(F.col("k") <= COMMON).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("k", "word", "count"))).alias("top"))
    total = sum(F.col(f"c{k}") for k in range(len(CLASSES) + 1))
    share = F.array(*[F.try_divide(F.col(f"c{k}"), total) for k in range(len(CLASSES) + 1)])
    return (
        classes.filter(F.col("words") >= MIN_REFERENCE)
        .join(top, "lang")
        .select(
            "lang",
            F.transform("top", lambda t: t["word"]).alias("common"),
            F.concat(F.transform("top", lambda t: t["count"] / F.col("words")), F.array(F.lit(1.0) - F.aggregate("top", F.lit(0).cast("long"), lambda a, t: a + t["count"]) / F.col("words"))).alias("word_share"),
            share.alias("class_share"),
        )
    )


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence, base 2, of two arrays of shares."""
    term = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)
    terms = F.zip_with(p, q, lambda a, b: 0.5 * (term(a, (a + b) / 2) + term(b, (a + b) / 2)))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x), F.lit(0.0)))


def quality_rules(docs: DataFrame, references: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``docs`` with the base counts, class_distance, word_distance (null without verdict) and kept."""
    references = written(references, "references")
    names = sorted(r[0] for r in references.select(F.explode("common")).distinct().limit(LOOKED_UP + 1).collect())
    # The table's own columns stay apart from those that are worked with.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(lang_col).alias("_own_lang"), F.col(text_col).alias("_text"))
    df = with_classes(base_counts(with_words(rows, "_text"), "_text"))
    refs = references.withColumnsRenamed({c: f"_{c}" for c in references.columns})
    df = df.join(refs, F.col("_own_lang") == F.col("_lang"), "left")
    # Few words are common in any language, so only they are looked for in the document's own; 0 stands for no place.
    few = F.filter("_words", lambda w: w.isin(names)) if len(names) <= LOOKED_UP else F.col("_words")
    place = F.transform(few, lambda w: F.array_position("_common", w).cast("int"))
    df = df.withColumn("_places", F.when(F.col("_common").isNotNull(), F.array_remove(place, 0)))
    n, found = F.col("n_words"), F.size("_places").cast("long")
    held = [found - F.size(F.array_remove("_places", k)) for k in range(1, COMMON + 1)] + [n - found]
    shares = F.array(*[F.try_divide(h, n) for h in held])
    # A language with fewer common words has shares of 0 beyond them.
    want = F.concat(F.slice("_word_share", 1, F.size("_common")), F.array_repeat(F.lit(0.0), F.lit(COMMON) - F.size("_common")), F.array(F.element_at("_word_share", -1)))
    guard = (n >= MIN_WORDS) & F.col("_common").isNotNull()
    df = df.withColumn("class_distance", F.when(guard, js_distance(F.transform("_classes", lambda c: F.try_divide(c, F.col("word_chars"))), F.col("_class_share"))))
    df = df.withColumn("word_distance", F.when(guard, js_distance(shares, want)))
    far = (F.coalesce("class_distance", F.lit(0.0)) > MAX_CLASS_DISTANCE) | (F.coalesce("word_distance", F.lit(0.0)) > MAX_WORD_DISTANCE)
    df = df.withColumn("kept", ~F.col("base_failed") & ~far)
    return df.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns if c not in JUDGED], *JUDGED)
