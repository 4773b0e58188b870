"""Typo corpora and measures (B1-B6). Choices follow md5 of the word and a seed, so reruns agree."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K


def draw(word: Column, seed: str, what: str, n: Column | int) -> Column:
    """0 .. n - 1, by hash."""
    digits = F.substring(F.md5(F.concat(word, F.lit(f"|{seed}|{what}"))), 1, 8)
    return F.pmod(F.conv(digits, 16, 10).cast("long"), n if isinstance(n, Column) else F.lit(n)).cast("int")


def mutate(words: DataFrame, seed: str = "42") -> DataFrame:
    """B1: word, typo, kind."""
    w, n = F.col("word"), F.length("word")
    part = lambda a, k: F.substring(w, a.cast("int") if isinstance(a, Column) else F.lit(a), k.cast("int") if isinstance(k, Column) else F.lit(k))
    kinds = ["transposition", "qwertz", "double_cons", "omission", "insertion", "phonetic"]
    i = F.lit(2) + draw(w, seed, "swap", n - 2)  # 1-based; the first letter stays
    swapped = F.concat(part(1, i - 1), part(i + 1, 1), part(i, 1), part(i + 2, 1000))
    j = F.lit(2) + draw(w, seed, "place", n - 1)
    at = part(j, 1)
    slip = F.lit(None).cast("string")
    for key, near in K.SLIPS.items():
        pick = F.substring(F.lit(near), (draw(w, seed, "key", len(near)) + 1).cast("int"), F.lit(1))
        slip = F.when(F.lower(at) == key, pick).otherwise(slip)
    slipped = F.when(slip.isNull(), w).otherwise(F.concat(part(1, j - 1), F.when((at == F.upper(at)) & (at != F.lower(at)), F.upper(slip)).otherwise(slip), part(j + 1, 1000)))
    doubled = F.concat(part(1, j), at, part(j + 1, 1000))
    places = F.filter(F.sequence(F.lit(2), n - 1), lambda p: (F.lower(F.substring(w, p.cast("int"), F.lit(1))) == F.lower(F.substring(w, (p + 1).cast("int"), F.lit(1)))) & F.substring(w, p.cast("int"), F.lit(1)).rlike(r"\p{L}"))
    first_double = F.get(places, F.lit(0))
    single = F.concat(part(1, first_double), part(first_double + 2, 1000))
    omitted = F.concat(part(1, j - 1), part(j + 1, 1000))
    k = F.lit(1) + draw(w, seed, "gap", n)
    letter = F.substring(F.lit(K.FREQUENT_LETTERS), (draw(w, seed, "letter", len(K.FREQUENT_LETTERS)) + 1).cast("int"), F.lit(1))
    inserted = F.concat(part(1, k), letter, part(k + 1, 1000))
    sound = F.concat(w, F.lit("e"))
    for a, b in reversed(K.SOUND_SWAPS):
        where = F.instr(w, a)
        sound = F.when(where > 0, F.concat(part(1, where - 1), F.lit(b), part(where + len(a), 1000))).otherwise(sound)
    kind = F.array(*map(F.lit, kinds))[draw(w, seed, "kind", len(kinds))]
    out = words.select("word").distinct().withColumn("kind", F.when(n < 4, "short").otherwise(kind))
    fixed = F.when(F.col("kind") == "short", F.concat(w, F.lit("x"))).when(F.col("kind") == "phonetic", sound).when((F.col("kind") == "double_cons") & first_double.isNotNull(), single)
    free = F.when(F.col("kind") == "transposition", swapped).when(F.col("kind") == "qwertz", slipped).when(F.col("kind") == "double_cons", doubled).when(F.col("kind") == "omission", omitted).otherwise(inserted)
    return out.withColumn("typo", F.coalesce(fixed, F.when(free == w, F.concat(w, F.lit("n"))).otherwise(free))).select("word", "typo", "kind")


def sample_words(words: DataFrame, n: int, seed: str = "42") -> DataFrame:
    """B2: n distinct words of letters, four and longer, those with the least hash."""
    good = words.select("word").distinct().where(F.col("word").rlike(r"^\p{L}{4,}$"))
    return good.orderBy(F.md5(F.concat("word", F.lit(f"|{seed}"))), "word").limit(n)


def typo_corpus(words: DataFrame, lexicon: DataFrame, known: DataFrame, n: int, seed: str = "42") -> DataFrame:
    """Word, label, base, kind: n real words; n typos, known ones first, then mutations that are no words."""
    real = sample_words(words, n, seed)
    made = mutate(real, seed).join(lexicon.select(F.col("word").alias("typo")), "typo", "left_anti").select(F.col("typo").alias("word"), F.col("word").alias("base"), "kind", F.lit(1).alias("turn"))
    listed = known.select(F.col("typo").alias("word"), F.lit(None).cast("string").alias("base"), F.lit("known").alias("kind"), F.lit(0).alias("turn"))
    typos = listed.union(made).orderBy("turn", F.md5(F.concat("word", F.lit(f"|{seed}"))), "word", "base").limit(n)
    return real.select("word", F.lit("real").alias("label"), F.col("word").alias("base"), F.lit("none").alias("kind")).union(typos.select("word", F.lit("typo"), "base", "kind"))


def recognition_rate(verdicts: DataFrame) -> DataFrame:
    """verdicts(correct) -> words, accepted, rate."""
    return verdicts.agg(F.count("*").alias("words"), F.count(F.when(F.col("correct"), 1)).alias("accepted"), F.round(F.avg(F.col("correct").cast("double")), 6).alias("rate"))


def suggestion_hit_rate(cases: DataFrame, k: int = 5) -> DataFrame:
    """cases(kind, rank) -> kind, typos, hits, rate, also over all kinds (null); a null rank is a miss."""
    hit = F.coalesce(F.col("rank") <= k, F.lit(False))
    return cases.rollup("kind").agg(F.count("*").alias("typos"), F.count(F.when(hit, 1)).alias("hits"), F.round(F.avg(hit.cast("double")), 6).alias("rate"))


def check_expectations(cases: DataFrame, actual: DataFrame) -> DataFrame:
    """cases(word, is_correct, expected_top1) against actual(word, correct, top1)."""
    out = cases.join(actual, "word", "left")
    verdict = F.col("is_correct").isNull() | (F.col("is_correct") == F.coalesce("correct", F.lit(False)))
    top = F.col("expected_top1").isNull() | F.coalesce(F.col("expected_top1") == F.col("top1"), F.lit(False))
    return out.withColumn("ok", verdict & top)
