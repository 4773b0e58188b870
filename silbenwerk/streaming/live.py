"""Revisions of texts as streams."""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import tokenize
from ..operators.detect import is_ignored, probe_forms
from ..operators.results import split_entries

REVISION = "doc_id long, revision int, ts timestamp, text string"


def _hand_on(key, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The state of a document: the revision that was handed on last and its latest time."""
    if state.hasTimedOut:
        state.remove()
        return
    last = lambda part: part.sort_values(["revision", "ts"]).iloc[-1:]
    parts, latest = [], 0
    for part in rows:
        parts.append(last(part))
        latest = max(latest, int(part["ts"].max().timestamp() * 1000))
    best = last(pd.concat(parts))
    revision, seen = int(best["revision"].iloc[0]), state.get if state.exists else (None, 0)
    if seen[0] is None or revision > seen[0]:
        yield best[["doc_id", "revision", "ts", "text"]]
    latest = max(latest, seen[1])
    state.update((revision if seen[0] is None else max(revision, seen[0]), latest))
    state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + 1)


def latest_revisions(stream: DataFrame, keep: str = "7 days") -> DataFrame:
    """Each document's newest revision of a batch, unless that or a later one has been handed on.

    The state is one number and one time for each document, kept by key under the checkpoint of the query that writes the result: a batch
    reads and writes the state of its own documents only (with RocksDB as the session's state store it need not fit in memory), a batch that runs again
    starts from the same state, and a query whose state is lost fails instead of handing old revisions on. A document whose latest
    revision lies more than `keep` behind the stream is forgotten, and rows that far behind are dropped, so nothing is handed on twice.
    Rows without document, revision or time are not handed on.
    """
    rows = stream.select("doc_id", "revision", "ts", "text").where("doc_id is not null and revision is not null and ts is not null").withWatermark("ts", keep)
    return rows.groupBy("doc_id").applyInPandasWithState(_hand_on, REVISION, "revision int, latest long", "append", GroupStateTimeout.EventTimeTimeout)


def quiet_revisions(stream: DataFrame, gap: str = "600 milliseconds", late: str = "1 second") -> DataFrame:
    """The last text of each burst of revisions, once the gap has passed."""
    return (stream.withWatermark("ts", late).groupBy("doc_id", F.session_window("ts", gap).alias("session"))
            .agg(F.max("revision").alias("revision"), F.max_by("text", "revision").alias("text"))
            .select("doc_id", "revision", "text", F.col("session.start").alias("from_ts"), F.col("session.end").alias("to_ts")))


def changed_sentences(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Z3: sentences (doc_id, ts, sentence) that were not checked before; forgotten after the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["doc_id", "sentence"])


def check_stream(stream: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Tokens of a stream that the static lexicon does not have under any probe form."""
    tokens = stream.select("doc_id", "ts", "text")
    rows = tokenize(tokens).where(~is_ignored(F.col("word")))
    forms = rows.withColumn("form", probe_forms(F.col("word"), F.col("is_first")))
    known = lexicon.select(F.col("word").alias("entry")).distinct()
    out = forms
    for i in range(4):  # at most four forms: one static join for each, so the stream needs no state
        entry = known.withColumnRenamed("entry", f"e{i}")
        out = out.join(entry, F.get("form", F.lit(i)) == F.col(f"e{i}"), "left")
    return out.where(" and ".join(f"e{i} is null" for i in range(4))).select("doc_id", "tok_ix", "word", "start", "end", "is_first")


CHANGE = "list_type string, low string, word string, present boolean, seq long, place int"


def _change_entry(key, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The state of an entry, in any case: its spelling, whether it is on the list, and the place of the last change."""
    word, present, seq, place = state.get if state.exists else (None, False, None, None)
    was = (word, present)
    for at, k, spelled, adds in sorted((int(r.seq), int(r.place), r.word, bool(r.adds)) for part in rows for r in part.itertuples()):
        if seq is not None and (at, k) <= (seq, place):
            continue  # a later change has been seen
        seq, place = at, k
        if adds != present:
            present, word = adds, spelled if adds else word
    state.update((word, present, seq, place))
    if (word, present) != was:
        yield pd.DataFrame({"list_type": [key[0]], "low": [key[1]], "word": [word], "present": [present], "seq": [seq], "place": [place]})


def list_changes(stream: DataFrame) -> DataFrame:
    """Of add, remove, ignore and unignore events (seq, action, text) those that change a list: list_type, low, word, present, seq, place.

    The state is one row for each entry that was ever named, kept by key under the checkpoint of the query; a batch costs what it
    changes, not what the lists hold. A change that comes after a later one of the same entry is dropped. `current_lists` makes lists of the result.
    """
    kind = F.when(F.col("action").isin("add", "remove"), "user").otherwise("ignored")
    rows = stream.select("seq", "action", kind.alias("list_type"), F.posexplode(split_entries(F.col("text"))).alias("place", "word")).where("seq is not null")
    rows = rows.select("list_type", F.lower("word").alias("low"), "word", "seq", "place", F.col("action").isin("add", "ignore").alias("adds"))
    return rows.groupBy("list_type", "low").applyInPandasWithState(_change_entry, CHANGE, "word string, present boolean, seq long, place int", "append", GroupStateTimeout.NoTimeout)


def current_lists(changes: DataFrame) -> DataFrame:
    """The lists (word, list_type) after the changes that `list_changes` wrote."""
    last = changes.groupBy("list_type", "low").agg(F.max_by(F.struct("word", "present"), F.struct("seq", "place")).alias("x"))
    return last.where("x.present").select("x.word", "list_type")
