"""Preparing text (T1-T9): words, offsets, sentences, protected spans, contexts.

Offsets count code points. White space and sentence ends follow ASCII line breaks and . ! ? …
Built-in expressions do the work; only offsets of tokens, which depend on each other from left to
right, are found by a small helper that runs where the text lies.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .. import constants as K

# The shape of a word, and what is never split into words.
DASH = r"\-‐-―−"
TOKEN = rf"(?:(?:\d+[{DASH}])+)?[\p{{L}}\p{{M}}]+(?:[{DASH}'‘’ʼ][\p{{L}}\p{{M}}\d]+)*(?:[{DASH}](?=\s|$|[.,;:!?]))?"
PROTECTED = [
    r"(?i)(?:https?://|www\.)[^\s<>\"']+",
    r"(?i)[\p{L}\p{N}._%+\-]+@[\p{L}\p{N}.\-]+\.\p{L}{2,}",
    r"(?i)(?:[\p{L}\p{N}](?:[\p{L}\p{N}\-]{0,62}\.)+)\p{L}{2,}(?:/[^\s<>\"']*)?",
    r"[#@][\p{L}\p{M}\p{N}_\-]+",
    r"(?=[\p{L}\p{M}\p{N}_]*[\p{N}_])[\p{L}\p{M}][\p{L}\p{M}\p{N}_]*",
    r"(?:[A-Za-z]:\\|\\\\)[^\s<>\"']+",
]
SENTENCE_START = r"(?:[.!?…]+|[\r\n]+|:)\s*[\"'„“‚‘’»«()\[\]{}\-–—]*\s*$"
SENTENCE = r"[^.!?…\r\n]+(?:[.!?…]+|[\r\n]+|$)"

_token, _starts = regex.compile(TOKEN), regex.compile(SENTENCE_START)
_protected = [regex.compile(p) for p in PROTECTED]
RANGE = [StructField("start", IntegerType()), StructField("end", IntegerType())]
RANGES = ArrayType(StructType(RANGE))
TOKEN_KINDS = {"tok_ix": pa.int32(), "word": pa.string(), "start": pa.int32(), "end": pa.int32(), "is_first": pa.bool_()}


@F.pandas_udf(StringType())
def nfc(words: pd.Series) -> pd.Series:
    return words.str.normalize("NFC")


def normalize_word(col: Column) -> Column:
    """Composed characters, one apostrophe, one dash."""
    return F.translate(nfc(col), K.APOSTROPHES + K.DASHES, "'" * len(K.APOSTROPHES) + "-" * len(K.DASHES))


def words_of(text: Column) -> Column:
    """T2 without offsets: all words of a text, by a built-in expression."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


#: No protected span holds white space, and each holds one of these.
_trigger = regex.compile(r"[@#\\_\p{N}]|://|\.\p{L}{2}|(?i:www\.)")
_back, _forth = regex.compile(r"(?r)\s"), regex.compile(r"\s")


def ranges_in(text: str) -> list[tuple[int, int]]:
    """Only pieces between white space that hold a trigger are looked at by all patterns."""
    out, at = set(), 0
    while (m := _trigger.search(text, at)) is not None:
        before, after = _back.search(text, at, m.start()), _forth.search(text, m.end())
        first, last = before.end() if before else at, after.start() if after else len(text)
        for p in _protected:
            out.update(x.span() for x in p.finditer(text, first, last))
        at = last
    return sorted(out)


@F.pandas_udf(RANGES)
def protected_ranges(texts: pd.Series) -> pd.Series:
    """Spans of addresses, mail, domains, tags, identifiers and file paths, by start."""
    return texts.map(lambda t: [{"start": a, "end": b} for a, b in ranges_in(t or "")])


def each_token(text: str) -> Iterator[tuple[int, str, int, int, bool]]:
    """tok_ix, word, start, end, is_first of each token, one after the other."""
    ranges, at, end, count = sorted(ranges_in(text), key=lambda r: (r[0], -r[1])), 0, 0, 0
    for m in _token.finditer(text):
        while at < len(ranges) and ranges[at][1] <= m.start():
            at += 1
        # T4: what overlaps a protected span is no token, and does not move the last token's end
        if at < len(ranges) and m.start() < ranges[at][1] and m.end() > ranges[at][0]:
            continue
        first = not count or _starts.search(text[end:m.start()]) is not None
        end = m.end()
        yield count, m[0], m.start(), end, first
        count += 1


def tokens_in(text: str) -> list[dict]:
    return [dict(zip(TOKEN_KINDS, t)) for t in each_token(text)]


BLANK = " \t\n\x0b\f\r"
_piece, _no_letter, _target, _hard_end = regex.compile(f"[^{BLANK}]+"), regex.compile(r"[^\p{L}]"), regex.compile(f"[^{BLANK}.,;:!?]*"), regex.compile(r"[.!?…\r\n]")
#: Of longer words only the beginning and the end are kept: no listed word is that long.
LONG = 64


def _shorter(letters: str) -> str:
    return letters if len(letters) <= LONG else letters[:2] + letters[2 - LONG:]


def words_before(text: str, starts: list[int]) -> list[tuple[bool, str, str, str, bool, str]]:
    """For each ascending start: (is nothing before it, first sign of the last piece before it, letters of that piece and of the one before,
    are there two, letters of what begins there). One pass: a piece that many starts share is read once."""
    bounds = [m.span() for m in _piece.finditer(text)]
    letters = lambda x: _no_letter.sub("", x.lower())
    out, i, read, held, previous, of = [], 0, 0, "", "", -1
    for start in starts:
        while i + 1 < len(bounds) and bounds[i + 1][0] < start:
            i += 1
        target = _shorter(letters(_target.match(text, start, min(len(text), start + 1000))[0]))
        if not bounds or bounds[i][0] >= start:
            out.append((True, "", "", "", False, target))
            continue
        first, end = bounds[i][0], min(bounds[i][1], start)
        if of != i:
            previous = _shorter(held + letters(text[read:bounds[i - 1][1]])) if i and of == i - 1 else _shorter(letters(text[slice(*bounds[i - 1])])) if i else ""
            of, read, held = i, first, ""
        held, read = _shorter(held + letters(text[read:end])), end
        out.append((False, text[first], held, previous, i > 0 or first > 0, target))
    return out


def context_of(text: str, start: int, end: int, radius: int = 280) -> tuple[str, int, int]:
    """T9 in place: (slice around a token up to the nearest terminators, its start and end in there)."""
    hard = max(0, start - radius)
    left = _hard_end.split(text[hard:start])[-1]
    stop = _hard_end.search(text, end, min(len(text), end + radius))
    return left + text[start:stop.end() if stop else end + radius], len(left), len(left) + end - start


BEFORE = "struct<none:boolean,first:string,last:string,previous:string,two:boolean,target:string>"


def tokens_in_place(docs: DataFrame, contexts: bool = True, before: bool = True, keep: Callable[[dict], bool] | None = None, text_col: str = "text", id_col: str = "doc_id", most: int = 5_000) -> DataFrame:
    """T2, T4, T5 with what surrounds each token: tokens as from `tokenize`, `sent_ix` (T6), `before` (see `words_before`) over the whole text,
    and `context` (T9: text, start, end) if asked for; `keep` says of a token (a dict of its columns) whether it is wanted. All is made where the text lies, in one pass, `most` rows at a time."""
    kind = docs.schema[id_col].dataType
    shape = f"doc_id {kind.simpleString()}, tok_ix int, word string, start int, end int, is_first boolean, sent_ix int" + f", before {BEFORE}" * before + ", context struct<text:string,start:int,end:int>" * contexts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(1)):
                text = text.as_py() or ""
                tokens = tokens_in(text)
                tokens = tokens if keep is None else [t for t in tokens if keep(t)]
                starts = [t["start"] for t in tokens]
                ahead = words_before(text, starts) if before else []
                inside = np.searchsorted(np.array([lo for lo, _ in sentence_bounds(text)], np.int64), np.array(starts, np.int64), "right") - 1
                for at in range(0, len(tokens), most):
                    part = tokens[at:at + most]
                    columns = [batch.column(0).take(pa.array([i] * len(part))), *(pa.array([t[c] for t in part], k) for c, k in (("tok_ix", pa.int32()), ("word", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("is_first", pa.bool_())))]
                    columns.append(pa.array(inside[at:at + most], pa.int32()))
                    names = ["doc_id", "tok_ix", "word", "start", "end", "is_first", "sent_ix"]
                    if before:
                        names.append("before")
                        columns.append(pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(zip(*ahead[at:at + most]), (pa.bool_(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string()))], ["none", "first", "last", "previous", "two", "target"]))
                    if contexts:
                        names.append("context")
                        columns.append(pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(zip(*(context_of(text, t["start"], t["end"]) for t in part)), (pa.string(), pa.int32(), pa.int32()))], ["text", "start", "end"]))
                    yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, shape)


def token_batches(batches: Iterator[pa.RecordBatch], most: int = 5_000) -> Iterator[pa.RecordBatch]:
    """doc_id, text -> doc_id and tokens, `most` rows at a time, however many texts come at once and however long they are."""
    for batch in batches:
        ids, held = [], []

        def rows() -> pa.RecordBatch:
            columns = [pa.array(c, k) for c, k in zip(zip(*held), TOKEN_KINDS.values())]
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids)), *columns], ["doc_id", *TOKEN_KINDS])

        for i, text in enumerate(batch.column(1)):
            for token in each_token(text.as_py() or ""):
                ids.append(i)
                held.append(token)
                if len(held) == most:
                    yield rows()
                    ids, held = [], []
        if held:
            yield rows()


def tokenize(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, tok_ix, word, start, end, is_first."""
    shape = f"doc_id {docs.schema[id_col].dataType.simpleString()}, tok_ix int, word string, start int, end int, is_first boolean"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lambda batches: token_batches(batches), shape)


_sentence, _a_letter = regex.compile(SENTENCE.replace("$", r"\Z")), regex.compile(r"\p{L}")


def sentence_bounds(text: str) -> list[tuple[int, int]]:
    """Spans up to a terminator that hold a letter, in order."""
    return [m.span() for m in _sentence.finditer(text) if _a_letter.search(text, *m.span())]


def sentences(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", most: int = 5_000) -> DataFrame:
    """doc_id, sent_ix, text, start, end of spans up to a terminator that hold a letter; in one pass, `most` rows at a time."""
    shape = f"doc_id {docs.schema[id_col].dataType.simpleString()}, sent_ix int, text string, start int, end int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(1)):
                text = text.as_py() or ""
                bounds = sentence_bounds(text)
                for at in range(0, len(bounds), most):
                    part = bounds[at:at + most]
                    columns = [batch.column(0).take(pa.array([i] * len(part))), pa.array(range(at, at + len(part)), pa.int32()), pa.array([text[lo:hi] for lo, hi in part], pa.string()), *(pa.array(c, pa.int32()) for c in zip(*part))]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "sent_ix", "text", "start", "end"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, shape)


def not_latin(text: Column) -> Column:
    """T7, first half: two letters or more, less than half of them Latin."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    latin = F.length(F.regexp_replace(F.regexp_replace(text, r"[^\p{L}]", ""), r"[^\p{IsLatin}]", ""))
    return (letters >= 2) & (latin < letters / 2)


def is_foreign(sents: DataFrame, detected: DataFrame | None = None) -> DataFrame:
    """Sentences with `foreign`. detected(text, language, percentage, reliable): what a detector said."""
    if detected is None:
        return sents.withColumn("foreign", not_latin(F.col("text")))
    said = detected.groupBy(F.trim("text").alias("key")).agg(F.max_by(F.struct("language", "reliable", "percentage"), "percentage").alias("best"))
    sure = F.col("best.reliable") & (F.col("best.percentage") >= 80) & ~F.col("best.language").rlike("(?i)^(?:de|und)(?:-|$)")
    out = sents.withColumn("key", F.trim("text")).join(said, "key", "left")
    return out.withColumn("foreign", (F.col("key") != "") & (not_latin(F.col("key")) | F.coalesce(sure, F.lit(False)))).drop("key", "best")


def german_tokens(docs: DataFrame, detected: DataFrame | None = None, tokens: DataFrame | None = None) -> DataFrame:
    """Tokens with a Latin letter outside foreign sentences; `tokens`: those of docs from `tokens_in_place`, if they are at hand.

    A token knows the number of its sentence, so foreign sentences leave by an equi-join.
    """
    foreign = is_foreign(sentences(docs), detected).where("foreign").select("doc_id", "sent_ix")
    plain = tokens is None
    tokens = (tokens_in_place(docs, contexts=False, before=False) if plain else tokens).where(F.col("word").rlike(r"\p{IsLatin}"))
    out = tokens.join(foreign, ["doc_id", "sent_ix"], "left_anti")
    return out.select("doc_id", "tok_ix", "word", "start", "end", "is_first") if plain else out


def local_context(text: Column, start: Column, end: Column, radius: int = 280) -> Column:
    """struct(text, start, end): the slice around a token up to the nearest terminators."""
    hard = F.greatest(F.lit(0), start - radius)
    before = F.substring(text, (hard + 1).cast("int"), (start - hard).cast("int"))
    left = F.element_at(F.split(before, r"[.!?…\r\n]"), -1)
    after = F.substring(text, (end + 1).cast("int"), F.lit(radius))
    right = F.regexp_extract(after, r"^([^.!?…\r\n]*[.!?…\r\n]?)", 1)
    word = F.substring(text, (start + 1).cast("int"), (end - start).cast("int"))
    at = F.length(left)
    return F.struct(F.concat(left, word, right).alias("text"), at.alias("start"), (at + end - start).alias("end"))
