"""Corpus statistics."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K


def word_frequencies(tokens: DataFrame) -> DataFrame:
    """Word (lower case), n."""
    return tokens.groupBy(F.lower("word").alias("word")).agg(F.count("*").alias("n"))


def totals(freq: DataFrame) -> DataFrame:
    """One row: total, types."""
    return freq.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("types"))


def case_evidence(tokens: DataFrame) -> DataFrame:
    """has_lower, has_title per lower-cased word, from words that do not begin a sentence."""
    w = F.col("word")
    titled = w.rlike(r"^\p{Lu}") & (F.substring(w, 2, 1000) == F.lower(F.substring(w, 2, 1000)))
    return tokens.groupBy(F.lower(w).alias("word")).agg(F.bool_or((w == F.lower(w)) & ~F.col("is_first")).alias("has_lower"), F.bool_or(titled & ~F.col("is_first")).alias("has_title"))


def frequency_table(tokens: DataFrame) -> DataFrame:
    """word, n, has_lower, has_title in one grouping."""
    w = F.col("word")
    titled = w.rlike(r"^\p{Lu}") & (F.substring(w, 2, 1000) == F.lower(F.substring(w, 2, 1000)))
    return tokens.groupBy(F.lower(w).alias("word")).agg(F.count("*").alias("n"), F.bool_or((w == F.lower(w)) & ~F.col("is_first")).alias("has_lower"), F.bool_or(titled & ~F.col("is_first")).alias("has_title"))


def log_prior(words: DataFrame, freq: DataFrame | None, user_words: DataFrame | None = None) -> DataFrame:
    """words(word) with log_prior; 0 for user words, a constant without a corpus."""
    if freq is None:
        out = words.withColumn("log_prior", F.lit(K.NO_CORPUS_PRIOR))
    else:
        one = F.broadcast(totals(freq))  # one row
        out = words.join(freq.select(F.col("word").alias("key"), "n"), F.lower("word") == F.col("key"), "left").drop("key").crossJoin(one)
        count = F.when(F.coalesce("n", F.lit(0)) > 0, F.col("n").cast("double")).otherwise(K.SMOOTHING)
        below = F.col("total") + K.SMOOTHING * F.greatest(F.lit(1), F.col("types") + 1)
        out = out.withColumn("log_prior", F.log(count) - F.log(F.greatest(F.lit(1.0), below))).drop("n", "total", "types")
    if user_words is not None:
        own = user_words.select(F.lower("word").alias("own")).distinct()
        out = out.join(own, F.lower("word") == F.col("own"), "left").withColumn("log_prior", F.when(F.col("own").isNotNull(), 0.0).otherwise(F.col("log_prior"))).drop("own")
    return out
