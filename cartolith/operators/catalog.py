"""Catalog of items: drop rules with their counts, work lists, incremental updates, acceptance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, scalar

NAME_PATTERN = "(?iU)(?:" + "|".join(fixed.NAME_ANYWHERE + fixed.NAME_ANCHORED) + ")"


def drop_reason(name: Column, groups: Column, reviews: Column, software: list[str] = fixed.SOFTWARE_GENRES, pattern: str = NAME_PATTERN, least: int = 10, item_id: Column | None = None) -> Column:
    """The first rule that an item fails, or null: bad_appid (if ``item_id`` is given), no_name, name_pattern, software_genre, few_reviews."""
    only = (F.size(groups) > 0) & (F.size(F.array_except(groups, F.array(*map(F.lit, software)))) == 0)
    bad = F.lit(False) if item_id is None else F.trim(item_id.cast("string")).try_cast("bigint").isNull()
    return (
        F.when(bad, "bad_appid")
        .when(F.length(F.trim(F.coalesce(name, F.lit("")))) == 0, "no_name")
        .when(name.rlike(pattern), "name_pattern")
        .when(only, "software_genre")
        .when(F.coalesce(reviews, F.lit(0)) < least, "few_reviews")
    )


def drop_counts(reasons: DataFrame, column: str = "reason") -> DataFrame:
    return reasons.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))


def review_score(positive: Column, negative: Column) -> list[Column]:
    total = positive + negative
    return [total.alias("review_count"), F.try_divide(positive, total).alias("review_score")]


def upper_median(df: DataFrame, column: str) -> DataFrame:
    """The value at place n div 2 in ascending order."""
    from .layout import value_at

    return value_at(df, column, lambda n: F.floor(n / 2)).withColumnRenamed("value", "upper_median")


def worklist(items: DataFrame, done: DataFrame, mode: str = "all", limit: int | None = None, key: str = "id", least: int = 3) -> DataFrame:
    """Items not done yet: those without enough tags first, then the rest, each by reviews."""
    left = items.join(done.select(key).distinct(), key, "left_anti").withColumn("is_gap", F.coalesce(F.size("tags"), F.lit(0)) < least)
    if mode == "gaps":
        left = left.filter("is_gap")
    order = left.orderBy(F.desc("is_gap"), F.desc("review_count"), key)
    return order.limit(limit) if limit else order


def retry_queue(failures: DataFrame, most: int = 3, key: str = "id") -> DataFrame:
    return failures.filter(F.col("tries") < most).orderBy("tries", key)


def upsert_latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key; ``order`` puts it first."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_k = 1").drop("_k")


def update_if_found(old: DataFrame, new: DataFrame, at: Column, key: str = "id") -> DataFrame:
    """Items after a look-up: tags are replaced where new ones were found; counts and score where there are reviews.

    ``new`` has (key, tags, positive, negative).  Found tags stamp ``fetched_at``.
    """
    n = new.select(key, F.col("tags").alias("_tags"), (F.coalesce("positive", F.lit(0)) + F.coalesce("negative", F.lit(0))).alias("_count"), F.col("positive").alias("_positive"))
    tagged, counted = F.size("_tags") > 0, F.col("_count") > 0
    j = old.join(n, key, "left")
    return (
        j.withColumn("tags", F.when(tagged, F.col("_tags")).otherwise(F.col("tags")))
        .withColumn("fetched_at", F.when(tagged, at).otherwise(F.col("fetched_at")))
        .withColumn("review_score", F.when(counted, F.col("_positive") / F.col("_count")).otherwise(F.col("review_score")))
        .withColumn("review_count", F.when(counted, F.col("_count")).otherwise(F.col("review_count")))
        .drop("_tags", "_count", "_positive")
    )


def crawl_log(new: DataFrame, at: Column, key: str = "id") -> DataFrame:
    """A row for each look-up that was answered, also with no tags."""
    return new.select(key, at.alias("fetched_at"), F.greatest(F.size("tags"), F.lit(0)).alias("n_tags"))


def clear_failures(failures: DataFrame, answered: DataFrame, key: str = "id") -> DataFrame:
    """Failures but those that have been answered since."""
    return failures.join(answered.select(key).distinct(), key, "left_anti")


def load_catalog(raw: DataFrame, short: DataFrame | None = None, least: int = 10) -> tuple[DataFrame, DataFrame]:
    """(items, dropped) of the 40-column CSV: kept items in the catalog's columns, and (reason, n) of the rest.

    ``short`` has (appID, short_description); rows whose id is no number are left out.
    """
    tags, genres = scalar.parse_tags(F.col("Tags")), scalar.parse_tags(F.col("Genres"))
    positive, negative = scalar.lenient_int(F.col("Positive")), scalar.lenient_int(F.col("Negative"))
    rows = raw.select(
        F.trim("AppID").try_cast("bigint").alias("id"),
        F.coalesce("Name", F.lit("")).alias("name"),
        F.coalesce(F.col("About the game"), F.lit("")).alias("long_desc"),
        tags.alias("tags"),
        genres.alias("genres"),
        F.coalesce(F.col("Release date"), F.lit("")).alias("release_date"),
        (positive + negative).alias("review_count"),
        F.try_divide(positive, positive + negative).alias("review_score"),
        F.col("Price").try_cast("double").alias("price"),
    )
    judged = rows.withColumn("reason", drop_reason(F.col("name"), F.col("genres"), F.col("review_count"), least=least, item_id=F.col("id")))
    kept = judged.filter("reason IS NULL").drop("reason")
    if short is None:
        return kept.withColumn("short_desc", F.lit("")), drop_counts(judged)
    s = short.select(F.col("appID").cast("string").try_cast("bigint").alias("id"), F.col("short_description").alias("_s")).filter("id IS NOT NULL AND _s IS NOT NULL")
    s = s.groupBy("id").agg(F.max("_s").alias("_s"))
    return kept.join(s, "id", "left").withColumn("short_desc", F.coalesce("_s", F.lit(""))).drop("_s"), drop_counts(judged)


def ordered_scan(items: DataFrame, min_tags: int = 0, key: str = "id") -> DataFrame:
    """All items by key, with JSON lists read, HTML cleaned and nulls filled; those with ``min_tags`` tags at least."""
    words = lambda c: F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))
    full = items.select(
        key,
        F.coalesce("name", F.lit("")).alias("name"),
        F.coalesce("short_desc", F.lit("")).alias("short_desc"),
        scalar.clean_html(F.col("long_desc")).alias("long_desc"),
        words("tags").alias("tags"),
        words("genres").alias("genres"),
        F.coalesce("review_count", F.lit(0)).alias("review_count"),
    )
    return full.filter(F.size("tags") >= min_tags).orderBy(key)


def count_failures(known: DataFrame, events: DataFrame, key: str = "id") -> DataFrame:
    """(key, status, tries): each event adds one try, the latest gives the status, cut to 200 characters."""
    new = events.groupBy(key).agg(F.count("*").alias("_n"), F.max_by("status", F.struct("at", "status")).alias("_s"))
    j = known.join(new, key, "full_outer")
    return j.select(key, F.left(F.coalesce("_s", "status"), F.lit(200)).alias("status"), (F.coalesce("tries", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("tries"))


def acceptance(items: DataFrame, least_rows: int = 50_000, least_tags: int = 3, least_coverage: float = 0.8) -> DataFrame:
    a = items.agg(F.count("*").alias("rows"), F.avg((F.coalesce(F.size("tags"), F.lit(0)) >= least_tags).cast("int")).alias("coverage"))
    return a.withColumn("passed", (F.col("rows") >= least_rows) & (F.col("coverage") >= least_coverage))


def tag_profile(docs: DataFrame, pattern: str = "[a-zà-ÿ]+", most: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(item, tag, votes, rank): the most frequent words of each text, ties by word; rank from 0."""
    words = docs.select(F.col(id_col).alias("item"), F.explode(F.regexp_extract_all(F.lower(text_col), F.lit(pattern), F.lit(0))).alias("tag"))
    counted = words.groupBy("item", "tag").agg(F.count("*").alias("votes"))
    w = Window.partitionBy("item").orderBy(F.desc("votes"), "tag")
    return counted.withColumn("rank", F.row_number().over(w) - 1).filter(F.col("rank") < most)
