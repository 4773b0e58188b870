"""Whole jobs: the stand-in lexicon, checking a corpus, measuring quality (D12, §3 of the survey)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import german_tokens, tokens_in_place
from ..operators.candidates import collect_candidates
from ..operators.context import accepted_words, check_context, confusion_group, noun_signal_before
from ..operators.detect import verdicts
from ..operators.ranking import suggest
from ..operators.results import merge_errors
from ..sharing import cut


def stand_in_lexicon(words: DataFrame, least: int = 3) -> DataFrame:
    """A lexicon from a corpus: spellings that occur `least` times, flagged by their shape."""
    w = F.col("word")
    counted = words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    noun = w.rlike(r"^\p{Lu}\p{Ll}+$")
    verb = w.rlike(r"^\p{Ll}{2,}en$")
    return counted.select("word", (F.when(noun, 1).otherwise(0) + F.when(verb, 2).otherwise(0)).alias("flags"))


def check_text(docs: DataFrame, lexicon: DataFrame, freq: DataFrame, typos: DataFrame | None = None, listed: DataFrame | None = None, detected: DataFrame | None = None, check_case: bool = True, limit: int = 5, scorer=None) -> DataFrame:
    """Errors per token with up to five suggestions; with a scorer (see X9) context errors as well, in the same pass over the texts.

    Tokens become distinct (word, is_first), then the wrong ones distinct (word, is_first,
    noun_signal); candidates and ranks are found for those and joined back. What stands before a token and around it is
    taken where the text lies. A token has a spelling error or a context error, never both (W1).
    """
    tokens = tokens_in_place(docs, contexts=scorer is not None)
    tokens = cut(german_tokens(docs, detected, tokens).withColumn("noun_signal", noun_signal_before(F.col("before"))).drop("before")) if scorer is None else cut(_confusable(german_tokens(docs, detected, tokens), typos, freq))
    found = cut(verdicts(tokens, lexicon, freq, typos, listed, check_case))
    wrong = found.where(~F.col("correct")).select("word", "is_first")
    hits = cut(tokens.drop("context", "members").join(wrong, ["word", "is_first"]))
    occurrences = hits.select("word", "is_first", "noun_signal").distinct()
    candidates = collect_candidates(wrong, lexicon, freq, typos, listed, limit)
    ranked = suggest(occurrences, candidates, lexicon, freq, limit, 5)
    lists = ranked.groupBy("word", "is_first", "noun_signal").agg(F.sort_array(F.collect_list(F.struct("rank", "suggestion"))).alias("r")).withColumn("suggestions", F.transform("r", lambda x: x["suggestion"])).drop("r")
    out = hits.join(lists, ["word", "is_first", "noun_signal"], "left").withColumn("suggestions", F.coalesce("suggestions", F.array().cast("array<string>")))
    spelling = out.select("doc_id", "start", "end", "word", "is_first", F.lit("spelling").alias("kind"), F.try_element_at("suggestions", F.lit(1)).alias("suggestion"), "suggestions")
    if scorer is None:
        return spelling
    right = tokens.where("members is not null").join(found.where("correct").select("word", "is_first"), ["word", "is_first"])
    groups = right.select("word", F.explode("members").alias("alternative")).distinct()
    slim = right.select("doc_id", "word", "start", "end", "is_first", F.col("context.text").alias("context"), F.col("context.start").alias("at"))
    taken = None if listed is None else accepted_words(slim, listed, check_case)
    return merge_errors(spelling, check_context(slim, groups, scorer, None, taken))


def _confusable(tokens: DataFrame, typos: DataFrame | None, freq: DataFrame) -> DataFrame:
    """Tokens with the members of their confusion group; only those keep their context."""
    groups = confusion_group(tokens.select("word"), typos, freq).groupBy("word").agg(F.sort_array(F.collect_set("alternative")).alias("members"))
    rows = tokens.withColumn("noun_signal", noun_signal_before(F.col("before"))).drop("before").join(groups, "word", "left")
    return rows.withColumn("context", F.when(F.col("members").isNotNull(), F.col("context")))
