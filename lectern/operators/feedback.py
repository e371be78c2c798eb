"""Ratings: feed, statistics, distribution and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions.text import or_default, star_bar, star_colour
from lectern.operators.joins import left_join_present


def ratings_feed(chat: DataFrame, users: DataFrame) -> DataFrame:
    """Rated rows with user names, newest first."""
    named = users.select("user_id", "username")
    return (
        left_join_present(chat.where(F.col("rating").isNotNull()), named, "user_id")
        .select(
            "id", "user_id", or_default(F.col("username"), "Anonymous").alias("username"), "ts",
            "question", "answer", "rating", "comment", "selected_text",
        )
        .orderBy(F.desc("ts"), F.desc("id"))
    )


def rating_stats(chat: DataFrame) -> DataFrame:
    """Count, average to two places (half to even), least and most; zeros without ratings."""
    r = F.col("rating")
    return chat.agg(
        F.count(r).alias("total_ratings"),
        F.coalesce(F.bround(F.avg(r).cast("decimal(20,10)"), 2).cast("double"), F.lit(0.0)).alias("average_rating"),
        F.coalesce(F.min(r), F.lit(0)).alias("min_rating"),
        F.coalesce(F.max(r), F.lit(0)).alias("max_rating"),
    )


def rating_distribution(chat: DataFrame) -> DataFrame:
    return (
        chat.where(F.col("rating").isNotNull()).groupBy("rating")
        .agg(F.count("*").alias("n")).orderBy("rating")
    )


def rating_distribution_map(chat: DataFrame) -> DataFrame:
    """The distribution as one MAP<INT, BIGINT>."""
    return rating_distribution(chat).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("rating", "n")))).alias("distribution")
    )


def rating_distribution_scaled(chat: DataFrame) -> DataFrame:
    """Each star 1 to 5, zero-filled, with its share of the largest count."""
    stars = chat.sparkSession.range(1, 6).select(F.col("id").cast("int").alias("rating"))
    counts = rating_distribution(chat)
    filled = stars.join(counts, "rating", "left").select("rating", F.coalesce("n", F.lit(0)).alias("n"))
    most = F.greatest(F.max("n").over(Window.partitionBy()), F.lit(1))
    return filled.select("rating", "n", (F.col("n") / most).alias("share_of_max"))


def rating_filter(chat: DataFrame, star: int | None = None) -> DataFrame:
    rated = chat.where(F.col("rating").isNotNull())
    return rated if star is None else rated.where(F.col("rating") == star)


def rating_filter_counts(chat: DataFrame) -> DataFrame:
    """'Showing x of y' for every choice of the star filter: ``all``, then one to five stars."""
    rated = chat.where(F.col("rating").isNotNull())
    showing = [F.count("*").alias("all"), *[F.count_if(F.col("rating") == s).alias(str(s)) for s in range(1, 6)]]
    counts = rated.agg(*showing)
    rows = F.array(*[F.struct(F.lit(c).alias("stars"), F.col(f"`{c}`").alias("showing")) for c in ("all", "1", "2", "3", "4", "5")])
    return counts.select(F.inline(rows), F.col("all").alias("of_total"))


def rating_display(feed: DataFrame) -> DataFrame:
    return feed.select(
        "id", "username", F.to_date("ts").alias("day"), star_bar(F.col("rating")).alias("stars"),
        star_colour(F.col("rating")).alias("colour"), "question",
        F.concat(F.lit("Context: "), F.substring("selected_text", 1, 80), F.lit("...")).alias("context_line"),
        or_default(F.col("comment"), "No feedback").alias("comment"),
    )


def admin_flags(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Whether each request's token belongs to an administrator; false when unknown."""
    known = users.groupBy("token").agg(F.max("is_admin").alias("is_admin"))
    return left_join_present(requests, known, "token").select(
        *requests.columns, F.coalesce(F.col("is_admin").cast("boolean"), F.lit(False)).alias("is_admin")
    )
