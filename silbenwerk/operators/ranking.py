"""Scoring and ranking of candidates."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.distance import pair_measures
from ..functions.scalars import cologne_phonetic, is_caps, is_title, key_bounce, title, upper_first
from ..sharing import cut
from .context import Scorer, fuse_scores, score_in_context
from .corpus import log_prior
from .detect import must_be_capitalized


def log_likelihood(pairs: DataFrame) -> DataFrame:
    """pairs(word, is_first, noun_signal, cand, cost, rewritten, known, must_cap) with `prefix` and `log_error`.

    Distances and shared ends are found once for each pair in lower case, sounds once for each word.
    """
    w, c = F.col("word"), F.col("cand")
    q, k = F.lower(w), F.lower(c)
    acronym = (F.length(c) >= 2) & (c == F.upper(c))
    caps = is_caps(w) & (F.length(w) > 1)
    sounds = pairs.select(q.alias("low")).union(pairs.select(k)).distinct().select("low", cologne_phonetic(F.col("low")).alias("sound"))
    measured = pairs.select(q.alias("q"), k.alias("k")).distinct().withColumn("m", pair_measures("q", "k"))
    measured = measured.join(sounds.toDF("q", "pq"), "q").join(sounds.toDF("k", "pk"), "k").select("q", "k", "m.*", "pq", "pk")
    pairs = pairs.withColumn("q", q).withColumn("k", k).join(measured, ["q", "k"])
    ends = lambda a, b: F.endswith(k, F.lit(a)) & F.endswith(q, F.lit(b))
    missing = (F.length(k) > F.length(q)) & (k.rlike(r"(.)\1") | (F.contains(k, F.lit("ch")) & ~F.contains(q, F.lit("ch"))) | ends("nung", "ung") | ends("en", "n") | ends("el", "l") | ends("er", "r"))
    add = lambda condition, x: F.when(condition, x).otherwise(0.0)
    pq, pk = F.col("pq"), F.col("pk")
    same = F.when(acronym & ~caps, -2.5).otherwise(0.5)
    other = (-2.2 * F.least("cost", "m2") + add(F.col("rewritten"), 0.5) + add(F.col("known"), 8.0) + add(missing, 0.8)
             + add((F.length(q) > F.length(k)) & key_bounce(q, k), 0.8) + add(~acronym & (pq != "") & (pq == pk), 0.9) - add(acronym & ~caps, 3.5))
    out = pairs.withColumn("log_error", F.when(q == k, same).otherwise(other))
    p, longest = F.col("prefix"), F.greatest(F.length(q), F.length(k))
    ratio, gap = p / F.greatest(F.lit(1), longest), F.abs(F.length(q) - F.length(k))
    s = F.when(p + F.col("tail") > F.length(c), F.greatest(F.lit(0.0), F.length(c) - p)).otherwise(F.col("tail"))
    ends_score = F.when(s >= 2, F.when(p > 0, F.least(s * 0.15, F.lit(0.60))).otherwise(F.least(s * 0.08, F.lit(0.25)))).otherwise(0.0)
    first = F.substring(c, 1, 1)
    upper = first == F.upper(first)
    case = (F.when(F.col("must_cap"), F.when(upper, 0.3).otherwise(-0.2)).when(is_title(w), F.when(upper, 0.3).otherwise(-0.3))
            .when(~F.col("is_first") & (first == F.lower(first)), 0.2).otherwise(0.0))
    total = F.col("log_error") + add(p >= 2, p * 0.25) + add((p >= 2) & (ratio >= 0.55), (ratio - 0.5) * 2) + F.when((gap == 0) & (p >= 3), 0.35).when(gap > 3, -(gap - 3) * 0.30).otherwise(0.0) + ends_score + case
    return out.withColumn("log_error", total).drop("q", "k", "m2", "tail", "pq", "pk")


def log_posterior(pairs: DataFrame) -> DataFrame:
    """R2: with log_posterior, distance, edit_score, confidence and the word as it is shown."""
    lp = F.col("log_error") + K.PRIOR_WEIGHT * F.col("log_prior")
    out = pairs.withColumn("log_posterior", lp).withColumn("distance", F.greatest(F.lit(0.1), -F.col("log_posterior") / 3)).withColumn("edit_score", 1 / (1 + F.col("distance")))
    return out.withColumn("confidence", F.least(F.lit(98), F.greatest(F.lit(10), F.floor(100 * F.col("edit_score") + 0.5)))).withColumn("confidence", F.col("confidence").cast("int"))


def shown(w: Column, c: Column, is_first: Column, must_cap: Column, keep_case: bool) -> Column:
    lift = is_first if keep_case else is_first | must_cap
    return F.when(is_caps(w) & (F.length(w) > 1), F.upper(c)).when(lift, upper_first(c)).otherwise(c)


RANKED = ["word", "is_first", "noun_signal", "suggestion", "rank", "log_posterior", "edit_score", "confidence", "from_user"]


def rank_candidates(scored: DataFrame, limit: int = 5, keep_case: bool = False) -> DataFrame:
    """The first `limit` by posterior, with the skip, stop and duplicate rules.

    Of suggestions that are shown alike the best stays. If the best candidate of all shares four
    letters at the beginning, those with fewer than two stay only among the first three. After the
    fifth (for words of 16 letters and more: after the first) what lies too far below the best ends the list.
    """
    own = ["word", "is_first", "noun_signal"]
    by_score = Window.partitionBy(*own).orderBy(F.desc("log_posterior"), "suggestion")
    shown_as = F.col("suggestion") if keep_case else F.lower("suggestion")
    rows = scored.select(*[c for c in RANKED if c != "rank"], "prefix", shown_as.alias("key"))
    rows = rows.withColumn("best", F.first("log_posterior").over(by_score)).withColumn("strong", F.first("prefix").over(by_score) >= 4)
    alike = Window.partitionBy(*own, "key").orderBy(F.desc("log_posterior"), "suggestion")
    rows = rows.withColumn("copy", F.row_number().over(alike)).where("copy = 1")
    rows = rows.withColumn("place", F.row_number().over(by_score)).where(~F.col("strong") | (F.col("prefix") >= 2) | (F.col("place") <= 3))
    rows = rows.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= limit)
    long_ = F.length("word") >= 16
    free, gap = F.when(long_, 1).otherwise(5), F.when(long_, 0.95).otherwise(4.5)
    return rows.where((F.col("rank") <= free) | (F.col("best") - F.col("log_posterior") <= gap)).select(RANKED)


def score_candidates(occurrences: DataFrame, candidates: DataFrame, lexicon: DataFrame, freq: DataFrame, keep_case: bool = False) -> DataFrame:
    """R1 and R2 for occurrences(word, is_first, noun_signal) and their candidates."""
    candidates = cut(candidates)  # used three times
    pairs = occurrences.select("word", "is_first", "noun_signal").distinct().join(candidates, ["word", "is_first"])
    cands = cut(candidates.select(F.col("cand").alias("word")).distinct())
    caps = must_be_capitalized(cands, lexicon, freq).withColumnRenamed("word", "cand")
    nouns = lexicon.where(F.col("flags").bitwiseAND(K.NOUN) != 0).select(F.col("word").alias("noun")).distinct().withColumn("is_noun", F.lit(True))
    prior = log_prior(cands, freq).withColumnRenamed("word", "cand")
    pairs = pairs.join(caps, "cand").join(prior, "cand").withColumn("noun", title(F.col("cand"))).join(nouns, "noun", "left")
    pairs = pairs.withColumn("must_cap", F.col("must_cap") | (F.col("noun_signal") & F.coalesce("is_noun", F.lit(False)))).withColumn("log_prior", F.when(F.col("from_user"), 0.0).otherwise(F.col("log_prior")))
    out = log_posterior(log_likelihood(pairs))
    return out.withColumn("suggestion", shown(F.col("word"), F.col("cand"), F.col("is_first"), F.col("must_cap"), keep_case))


def suggest(occurrences: DataFrame, candidates: DataFrame, lexicon: DataFrame, freq: DataFrame, limit: int = 10, show: int = 5) -> DataFrame:
    """R4 without a context scorer: the first suggestions of each (word, is_first, noun_signal)."""
    return rank_candidates(score_candidates(occurrences, candidates, lexicon, freq), limit).where(F.col("rank") <= show)


def suggest_in_context(occurrences: DataFrame, candidates: DataFrame, lexicon: DataFrame, freq: DataFrame, scorer: Scorer | DataFrame, limit: int = 16, show: int = 5) -> DataFrame:
    """R4 with a context scorer: occ_id, suggestion, rank.

    occurrences(occ_id, word, is_first, noun_signal, context, start, end): start and end are places in
    the context. `limit` candidates in all their cases are scored in the context and fused; where the
    context holds no letter besides the word, the order by spelling stays.
    """
    ranked = rank_candidates(score_candidates(occurrences, candidates, lexicon, freq, keep_case=True), limit, keep_case=True)
    pairs = occurrences.join(ranked, ["word", "is_first", "noun_signal"])
    around = F.concat(F.substring("context", F.lit(1), F.col("start").cast("int")), F.substring("context", (F.col("end") + 1).cast("int"), F.lit(1_000_000)))
    pairs = cut(pairs.withColumn("open", F.coalesce(around.rlike(r"\p{L}"), F.lit(False))))
    scored = score_in_context(pairs.where("open").select("occ_id", "context", "start", F.col("suggestion").alias("candidate"), "rank", "edit_score", "log_posterior", "from_user"), scorer)
    fused = fuse_scores(scored.select("occ_id", F.col("candidate").alias("word"), "edit_score", "log_posterior", "log_score", "from_user", "rank"))
    out = fused.select("occ_id", F.col("word").alias("suggestion"), "rank").unionByName(pairs.where("not open").select("occ_id", "suggestion", "rank"))
    return out.where(F.col("rank") <= show)


def user_list_view(lists: DataFrame, query: str = "") -> DataFrame:
    """Entries that contain the query, in German order, with the size of their list."""
    sized = lists.join(F.broadcast(lists.groupBy("list_type").agg(F.count("*").alias("entries"))), "list_type")  # one row for each list
    return sized.where(F.contains(F.lower("word"), F.lit(query.lower()))).orderBy(F.collate("word", "de_CI_AI"), "word")
