"""What the context tells (X1-X10). Scorers and language detectors are callables or tables."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.scalars import match_case, title


def participle_or_adverb(w: Column) -> Column:
    """X2"""
    participle = F.startswith(w, F.lit("ge")) & w.rlike("(?:en|t|et)$") & ~w.rlike("(?:enes|enem|ener|ene|enen|etes|etem|eter|ete|eten)$")
    return w.isin(K.NO_ADJECTIVES) | participle


def noun_signal(context: Column, start: Column) -> Column:
    """Does the text before `start` announce a noun?"""
    letters = lambda x: F.regexp_replace(F.lower(x), r"[^\p{L}]", "")
    before = F.regexp_replace(F.substring(context, F.lit(1), F.greatest(start, F.lit(0)).cast("int")), r"\s+$", "")
    words = F.split(before, r"\s+")
    raw = F.coalesce(F.try_element_at(words, F.lit(-1)), F.lit(""))
    last, previous = letters(raw), letters(F.coalesce(F.try_element_at(words, F.lit(-2)), F.lit("")))
    target = letters(F.regexp_extract(F.substring(context, (start + 1).cast("int"), F.lit(1000)), r"^\s*([^\s.,;:!?]*)", 1))
    none = context.isNull() | start.isNull() | (start < 0) | (raw == "")
    return _announced(none, F.substring(raw, 1, 1), last, previous, F.size(words) >= 2, target)


def noun_signal_before(before: Column) -> Column:
    """X1 of a token from `tokens_in_place`: what stands before it in the whole text."""
    return _announced(before["none"], before["first"], before["last"], before["previous"], before["two"], before["target"])


def _announced(none: Column, first: Column, last: Column, previous: Column, has_two: Column, target: Column) -> Column:
    infinitive = (last == "zu") & ((has_two & previous.isin(K.BEFORE_ZU)) | ((target != "") & ~target.isin(K.AFTER_ZU)))
    superlative = (last == "am") & target.rlike("(?:sten|stn|ten|tn)$") & ~target.isin(K.AFTER_AM)
    adjective = has_two & (first == F.lower(first)) & ~participle_or_adverb(last)
    determined = previous.isin(K.DETERMINERS) & last.rlike("(?:em|en|er|es|e)$")
    signalled = previous.isin(K.NOUN_SIGNALS) & (last.rlike("(?:em|er|es)$") | (F.endswith(last, F.lit("en")) & (target != "") & ~target.rlike("(?:en|eln|ern)$")))
    return F.when(none, False).when(infinitive | superlative, False).when(last.isin(K.NOUN_SIGNALS), True).otherwise(adjective & (determined | signalled))


def viable_head(words: DataFrame, lexicon: DataFrame, freq: DataFrame, compounds: DataFrame | None = None) -> DataFrame:
    """Words that may be the head of a compound: attested, productive ending, noun in -er, or a compound."""
    w = F.col("word")
    rows = words.select("word").distinct().where(F.length(w) >= 3).withColumn("low", F.lower(w)).withColumn("tit", title(w))
    nouns = lexicon.where(F.col("flags").bitwiseAND(K.NOUN) != 0).select(F.col("word").alias("tit")).distinct().withColumn("noun", F.lit(True))
    seen = freq.where("n >= 1 or has_lower or has_title").select(F.col("word").alias("low")).withColumn("seen", F.lit(True))
    rows = rows.join(nouns, "tit", "left").join(seen, "low", "left")
    ok = F.coalesce("seen", F.lit(False)) | F.col("low").rlike(K.HEADS) | ((F.length("low") >= 4) & F.endswith("low", F.lit("er")) & F.coalesce("noun", F.lit(False)))
    if compounds is not None:
        by = compounds.select(F.col("word").alias("c")).distinct()
        rows = rows.join(by.select(F.col("c").alias("tit"), F.lit(True).alias("ct")), "tit", "left").join(by.select(F.col("c").alias("low"), F.lit(True).alias("cl")), "low", "left")
        ok = ok | F.coalesce("ct", "cl", F.lit(False))
    return rows.where(ok).select("word").distinct()


def confusion_group(words: DataFrame, typos: DataFrame | None = None, freq: DataFrame | None = None) -> DataFrame:
    """Word, alternative: the members of a word's confusion group, itself included."""
    spark = words.sparkSession
    pairs = spark.createDataFrame([(w.lower(), alternative) for pair in K.CONFUSION_PAIRS for w in pair for alternative in pair], "key string, alternative string")
    rows = words.select("word").distinct().withColumn("key", F.lower("word"))
    fixed = rows.join(F.broadcast(pairs), "key").select("word", "alternative")  # a few dozen rows
    if typos is None:
        return fixed
    ss = lambda c: F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))
    listed = rows.join(fixed.select("word"), "word", "left_anti").join(typos, F.col("key") == F.col("typo")).where((F.lower("correction") != F.col("key")) & (ss("correction") != ss("key")))
    if freq is not None:
        listed = listed.join(freq.where("n >= 3").select(F.col("word").alias("key")), "key", "left_anti")
    return fixed.union(listed.select("word", F.explode(F.array("word", "correction")).alias("alternative")))


def pieces_of(word: str, vocab: dict[str, int], unknown: int) -> list[int]:
    """Greedy longest pieces; a word with a part that has none is unknown."""
    at, out = 0, []
    while at < len(word):
        for end in range(len(word), at, -1):
            piece = vocab.get(("##" if at else "") + word[at:end])
            if piece is not None:
                out.append(piece)
                at = end
                break
        else:
            return [unknown]
    return out


def held_vocabulary(vocab: DataFrame, most_pieces: int = 200_000) -> dict[str, int]:
    """piece -> id; tasks hold it, so its size is checked."""
    rows = vocab.select("piece", "id").limit(most_pieces + 1).collect()
    if len(rows) > most_pieces:
        raise ValueError(f"a vocabulary of more than {most_pieces} pieces is not held in tasks")
    return {r.piece: r.id for r in rows}


def wordpiece_encode(words: DataFrame, vocab: DataFrame, most_pieces: int = 200_000, unknown: str = "[UNK]") -> DataFrame:
    """words(word) -> word, pieces. The vocabulary is held by each task; its size is checked."""
    shared = words.sparkSession.sparkContext.broadcast(held_vocabulary(vocab, most_pieces))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for batch in batches:
            batch["pieces"] = [pieces_of(w or "", own, own.get(unknown, 0)) for w in batch["word"]]
            yield batch

    return words.select("word").mapInPandas(run, "word string, pieces array<int>")


#: Fixed value: what of a text is cut into pieces.
BASIC = regex.compile(r"\[MASK\]|[\p{L}\p{M}\p{N}]+|[^\s\p{L}\p{M}\p{N}]")


def text_pieces(shared, unknown: str = "[UNK]"):
    """X5 for texts: a column function; shared: a broadcast vocabulary."""
    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        own, seen = shared.value, {}

        def pieces(word: str) -> list[int]:
            if word not in seen:
                seen[word] = [own[word]] if word == "[MASK]" and word in own else pieces_of(word, own, own.get(unknown, 0))
            return seen[word]

        return texts.map(lambda t: [p for w in BASIC.findall(t or "") for p in pieces(w)])

    return run


def masked_inputs(occurrences: DataFrame, mask_id: int, window: int = 510) -> DataFrame:
    """occurrences(occ_id, pieces_before, pieces_after, n) -> occ_id, n, input, mask_at.

    The word is n masks; of the pieces around them those within the window stay.
    """
    return occurrences.select("occ_id", "n", *_masked(mask_id, window))


def _masked(mask_id: int, window: int) -> tuple[Column, Column]:
    room = F.lit(window) - F.col("n")
    half = (room / 2).cast("int")
    before, after = F.size("pieces_before"), F.size("pieces_after")
    left = F.least(before, F.greatest(half, room - after))
    right = F.least(after, room - left)
    kept = F.slice("pieces_before", before - left + 1, left)
    masks = F.transform(F.sequence(F.lit(1), F.col("n")), lambda _: F.lit(mask_id))
    return F.concat(kept, masks, F.slice("pieces_after", F.lit(1), right)).alias("input"), F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: i + left).alias("mask_at")


Scorer = Callable[[pd.DataFrame], "pd.Series"]


def score_in_context(pairs: DataFrame, scorer: Scorer | DataFrame) -> DataFrame:
    """pairs(context, start, candidate, ...) with log_score, null where the scorer says nothing.

    A table(context, start, candidate, log_score) is joined; a callable gets batches of distinct
    (context, start, candidate) and returns a score for each, on the executors.
    """
    if isinstance(scorer, DataFrame):
        return pairs.join(scorer.select("context", "start", "candidate", "log_score"), ["context", "start", "candidate"], "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["log_score"] = scorer(batch)
            yield batch

    keys = pairs.select("context", "start", "candidate").distinct()
    scored = keys.mapInPandas(run, "context string, start int, candidate string, log_score double")
    return pairs.join(scored, ["context", "start", "candidate"], "left")


#: (inputs of any length, places of the masks: one row each, equally many) -> logits[input, mask, piece]
PieceModel = Callable[[list[np.ndarray], np.ndarray], np.ndarray]
_loaded: dict[str, PieceModel] = {}


def mean_log_probabilities(logits: np.ndarray, wanted: list[list[int]]) -> list[float | None]:
    """Of one input: for each candidate the mean of its pieces' log-probabilities at the masks; null unless finite."""
    top = logits.max(1, keepdims=True)
    logs = logits - (top + np.log(np.exp(logits - top).sum(1, keepdims=True)))
    at = np.arange(logits.shape[0])
    means = [float(logs[at, pieces].mean()) if max(pieces) < logs.shape[1] else -np.inf for pieces in wanted]
    return [m if np.isfinite(m) else None for m in means]


def score_pieces(pairs: DataFrame, vocab: DataFrame, load: Callable[[], PieceModel], name: str, window: int = 510, batch: int = 32, mask: str = "[MASK]", first: str = "[CLS]", last: str = "[SEP]") -> DataFrame:
    """pairs(context, start, end, candidate, ...) with log_score, the mean log-probability of the candidate's pieces at as many masks.

    Each (context, start, end) is masked once for each number of pieces that its candidates have. `load` makes a model on a worker, which keeps it
    under `name` for all its tasks; the model gets up to `batch` inputs of one number of masks. Candidates without pieces, or
    with pieces beyond the model's, have no score.
    """
    held = held_vocabulary(vocab)
    shared = pairs.sparkSession.sparkContext.broadcast(held)
    pieces = text_pieces(shared)
    mask_id, ends = held.get(mask, 104), (held.get(first, 101), held.get(last, 102))
    place = ["context", "start", "end"]
    keys = pairs.select(*place, "candidate").where("start >= 0 and end > start and candidate is not null").distinct()
    coded = keys.withColumn("pieces", pieces("candidate")).where(F.size("pieces") > 0)
    grouped = coded.groupBy(*place, F.size("pieces").alias("n")).agg(F.collect_list("candidate").alias("candidates"), F.collect_list("pieces").alias("wanted"))
    # several numbers of pieces share a context: it is cut into pieces once for each, where the group lies
    sides = grouped.withColumn("pieces_before", pieces(F.substring("context", F.lit(1), F.col("start").cast("int")))).withColumn("pieces_after", pieces(F.expr("substring(context, end + 1)")))
    inputs = sides.select(*place, "n", "candidates", "wanted", *_masked(mask_id, window)).sortWithinPartitions("n")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if name not in _loaded:
            _loaded[name] = load()
        model = _loaded[name]

        def scored(rows: pd.DataFrame) -> pd.DataFrame:
            texts = [np.concatenate([[ends[0]], x, [ends[1]]]).astype(np.int64) for x in rows["input"]]
            logits = model(texts, np.stack(rows["mask_at"].tolist()).astype(np.int64) + 1)
            out = rows[["context", "start", "end"]].assign(candidate=rows["candidates"], log_score=[mean_log_probabilities(x, [list(p) for p in w]) for x, w in zip(logits, rows["wanted"])])
            return out.explode(["candidate", "log_score"]).astype({"log_score": "float64"})

        for frame in batches:
            for _, same in frame.groupby("n", sort=False):
                for at in range(0, len(same), batch):
                    yield scored(same.iloc[at:at + batch])

    scores = inputs.mapInPandas(run, "context string, start int, end int, candidate string, log_score double")
    return pairs.join(scores, [*place, "candidate"], "left")


class PairModel:
    """A piece model of counts: the logit of a piece at a mask is ln(times it followed the piece before the mask + alpha)."""

    def __init__(self, before: np.ndarray, piece: np.ndarray, n: np.ndarray, size: int, alpha: float):
        order = np.argsort(before, kind="stable")
        self.before, self.piece, self.logit = before[order], piece[order], np.log(n[order] + alpha)
        self.size, self.rest = size, np.log(alpha)

    def __call__(self, inputs: list[np.ndarray], mask_at: np.ndarray) -> np.ndarray:
        out = np.full((*mask_at.shape, self.size), self.rest)
        for i, places in enumerate(mask_at):
            for j, at in enumerate(places):
                low, high = np.searchsorted(self.before, [inputs[i][at - 1], inputs[i][at - 1] + 1])
                out[i, j, self.piece[low:high]] = self.logit[low:high]
        return out


def pair_model(counts: DataFrame, size: int, alpha: float = 1.0, most: int = 2_000_000) -> Callable[[], PairModel]:
    """counts(before, piece, n) as a loader for `score_pieces`; tasks hold the table, so its size is checked."""
    rows = counts.select("before", "piece", "n").limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError(f"more than {most} pairs of pieces are not held in tasks")
    shared = counts.sparkSession.sparkContext.broadcast(tuple(rows[c].to_numpy(np.int64) for c in ("before", "piece", "n")))
    return lambda: PairModel(*shared.value, size, alpha)


def fuse_scores(pairs: DataFrame) -> DataFrame:
    """pairs(occ_id, word, edit_score, log_posterior, log_score, from_user[, rank]) -> occ_id, word, family_score, surface_score, rank.

    A family is a word in any case: its best spelling score and each member's context score count, and
    the member that looks best stands for it. The user's own words get a bonus in both. Without any
    context score the rows stay as they came, in the order of `rank` or else of their spelling score,
    which is then their family score; the surface score is their edit score.
    """
    occ, fam = Window.partitionBy("occ_id"), Window.partitionBy("occ_id", "family")
    rows = pairs.withColumn("family", F.lower("word")).withColumn("lp", F.coalesce("log_posterior", -3 * F.greatest(F.lit(0.1), 1 / F.col("edit_score") - 1)))
    came = [F.col("rank")] if "rank" in pairs.columns else [F.desc("lp"), F.col("word")]
    rows = rows.withColumn("came", F.row_number().over(occ.orderBy(*came)))
    rows = rows.withColumn("any_score", F.count("log_score").over(occ) > 0).withColumn("top", F.max("log_score").over(occ))
    weight = F.when(F.col("log_score").isNotNull(), F.exp(F.col("log_score") - F.col("top"))).otherwise(0.0)
    rows = rows.withColumn("share", F.try_divide(weight, F.sum(weight).over(occ)))
    bonus = F.when(F.col("from_user"), 0.35).otherwise(0.0)
    rows = rows.withColumn("spelled", F.max("lp").over(fam))
    rows = rows.withColumn("family_score", F.max(F.col("spelled") + 0.35 * F.col("log_score") + bonus).over(fam))
    rows = rows.withColumn("surface_score", 0.30 * F.coalesce("share", F.lit(0.0)) + 0.70 * F.col("edit_score") + bonus)
    open_ = rows.where("any_score").withColumn("first", F.min("came").over(fam)).withColumn("r", F.row_number().over(fam.orderBy(F.desc("surface_score"), "came"))).where("r = 1")
    open_ = open_.withColumn("rank", F.row_number().over(occ.orderBy(F.desc_nulls_last("family_score"), "first")))
    out = ["occ_id", "word", "family_score", "surface_score", "rank"]
    kept = rows.where("not any_score").select("occ_id", "word", F.col("lp").alias("family_score"), F.col("edit_score").alias("surface_score"), F.col("came").alias("rank"))
    return open_.select(out).unionByName(kept)


def accepted_words(tokens: DataFrame, lists: DataFrame, check_case: bool = True) -> DataFrame:
    """Tokens on a user or ignore list, exactly, or in any case when case is not checked."""
    key = (lambda c: c) if check_case else F.lower
    return tokens.join(lists.select(key(F.col("word")).alias("entry")).distinct(), key(F.col("word")) == F.col("entry"), "left_semi")


def check_context(tokens: DataFrame, groups: DataFrame, scorer: Scorer | DataFrame | Callable[[DataFrame], DataFrame], spelling: DataFrame | None = None, accepted: DataFrame | None = None) -> DataFrame:
    """tokens(doc_id, word, start, end, is_first, context, at) whose best alternative is ahead by the margin.

    groups(word, alternative) as from X4; spelling errors (doc_id, start) and accepted tokens are left out. A word without a score counts
    as minus infinity if it is in its group, and is no error if it is not. scorer: as in X7, or a function of pairs(context, start, end,
    candidate, ...) that adds log_score, as `score_pieces` does.
    """
    rows = tokens
    for out in (spelling, accepted):
        if out is not None:
            rows = rows.join(out.select("doc_id", "start"), ["doc_id", "start"], "left_anti")
    rows = rows.join(groups, "word").withColumn("candidate", match_case(F.col("alternative"), F.col("word"), F.col("is_first")))
    pairs = rows.select("doc_id", F.col("start").alias("pos"), F.col("end").alias("until"), "word", "is_first", "candidate", "context", F.col("at").alias("start"), (F.col("at") + F.col("end") - F.col("start")).cast("int").alias("end"))
    scored = scorer(pairs) if getattr(scorer, "of_pairs", False) else score_in_context(pairs, scorer)
    own = F.lower("candidate") == F.lower("word")
    least = F.lit(float("-inf"))
    scored = scored.withColumn("log_score", F.coalesce("log_score", least))
    best = scored.groupBy("doc_id", "pos", "until", "word", "is_first").agg(F.max(F.struct("log_score", "candidate")).alias("best"), F.max(F.when(own, F.col("log_score"))).alias("own"))
    ahead = (F.col("best.log_score") > least) & F.col("own").isNotNull() & (F.col("best.log_score") - F.col("own") >= K.CONTEXT_MARGIN)
    hit = best.where((F.lower("best.candidate") != F.lower("word")) & ahead)
    return hit.select("doc_id", F.col("pos").alias("start"), F.col("until").alias("end"), "word", "is_first", F.lit("context").alias("kind"), F.col("best.candidate").alias("suggestion"), F.array("best.candidate").alias("suggestions"))


def by_pieces(vocab: DataFrame, load: Callable[[], PieceModel], name: str, **options) -> Callable[[DataFrame], DataFrame]:
    """A scorer for X9 that works on pieces."""
    def score(pairs: DataFrame) -> DataFrame:
        return score_pieces(pairs, vocab, load, name, **options)

    score.of_pairs = True
    return score
