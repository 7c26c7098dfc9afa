"""Overlap of two sets of texts by token shingles, and lookups by rarest token."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import words

SHINGLE = 13
LIMIT = 0.8


def shingles(tokens: Column, size: int = SHINGLE) -> Column:
    """Distinct runs of ``size`` tokens; shorter texts have none."""
    # The tokens are bound once: inside a lambda their expression would be evaluated for every shingle (and F.get would evaluate them twice).
    none = F.array().cast("array<string>")

    def runs(t: Column) -> Column:
        return F.when(F.size(t) >= size, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(t) - size + 1), lambda i: F.array_join(F.slice(t, i, size), " ")))).otherwise(none)

    return F.transform(F.array(tokens), runs)[0]


def leak_check(train: DataFrame, test: DataFrame, size: int = SHINGLE, limit: float = LIMIT) -> DataFrame:
    """(train_id, test_id, shared, jaccard, train_in_test, test_in_train, flagged) of pairs that share a shingle.

    Both sides: (id, text). The train side is cut to shingles that the test side has before anything is joined by
    pair, so postings follow the test set's size.
    """
    cut = lambda df, n: df.select(F.col("id").alias(n), shingles(words(F.lower("text")), size).alias("s"))
    a, b = cut(train, "train_id"), cut(test, "test_id")
    rows_b = b.select("test_id", F.size("s").alias("nb"), F.explode("s").alias("g"))
    rows_a = a.select("train_id", F.size("s").alias("na"), F.explode("s").alias("g"))
    pairs = rows_a.join(rows_b, "g").groupBy("train_id", "test_id", "na", "nb").agg(F.count("*").alias("shared"))
    ratio = lambda n: F.round(F.col("shared") / n, 6)
    out = pairs.select(
        "train_id", "test_id", "shared", ratio(F.col("na") + F.col("nb") - F.col("shared")).alias("jaccard"),
        ratio(F.col("na")).alias("train_in_test"), ratio(F.col("nb")).alias("test_in_train"),
    )
    return out.withColumn("flagged", F.greatest("jaccard", "train_in_test", "test_in_train") >= limit)


def rarest_token(test: DataFrame, train: DataFrame) -> DataFrame:
    """(id, token, df): of each test text's tokens the one that fewest train texts hold, ties by token."""
    df = train.select("id", F.explode(F.array_distinct(words(F.lower("text")))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    tokens = test.select("id", F.explode(F.array_distinct(words(F.lower("text")))).alias("token"))
    return tokens.join(df, "token", "left").groupBy("id").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), F.col("token"))).alias("m")).select("id", "m.token", "m.df")


def value_hits(values: DataFrame, texts: DataFrame) -> DataFrame:
    """(value_id, id): texts that hold a value's tokens in a row. Joined by the value's rarest token, then verified."""
    joined = lambda c: F.concat(F.lit(" "), F.array_join(words(F.lower(c)), " "), F.lit(" "))
    probe = rarest_token(values.select(F.col("value_id").alias("id"), F.col("value").alias("text")), texts).select(F.col("id").alias("value_id"), "token")
    keyed = values.join(probe, "value_id").select("value_id", "token", joined("value").alias("v"))
    tokens = texts.select("id", joined("text").alias("t"), F.explode(F.array_distinct(words(F.lower("text")))).alias("token"))
    return keyed.join(tokens, "token").where(F.col("t").contains(F.col("v"))).select("value_id", "id").distinct()


def sampled_overlap(a: DataFrame, b: DataFrame, size: int = 10, one_in: int = 8) -> DataFrame:
    """Share of a's sampled shingles, and of a's texts with any, that b has too: one shingle hash in so many is kept."""
    kept = lambda df: df.select("id", F.explode(shingles(words(F.lower("text")), size)).alias("g")).withColumn("h", F.xxhash64("g")).where(F.pmod("h", F.lit(one_in)) == 0)
    marks = kept(b).select("h").distinct().withColumn("hit", F.lit(True))
    rows = kept(a).select("id", "h").distinct().join(marks, "h", "left")
    return rows.agg(
        F.count("*").alias("shingles"), F.count("hit").alias("shared"), F.countDistinct("id").alias("texts"), F.countDistinct(F.when(F.col("hit"), F.col("id"))).alias("texts_hit")
    )
