"""Document-level results."""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.scalars import shared_head


def merge_errors(spelling: DataFrame, context: DataFrame) -> DataFrame:
    """All errors; at the same start the spelling error stays."""
    return spelling.unionByName(context.join(spelling.select("doc_id", "start"), ["doc_id", "start"], "left_anti"))


def error_still_matches(text: Column, start: Column, end: Column, word: Column) -> Column:
    """The slice is the word, and no word goes on at either side."""
    inner = F.substring(text, (start + 1).cast("int"), (end - start).cast("int")) == word
    before = F.when(start > 0, F.substring(text, start.cast("int"), F.lit(1))).otherwise("")
    after = F.substring(text, (end + 1).cast("int"), F.lit(1))
    letter = r"[\p{L}\p{M}\p{N}_]"
    return (start >= 0) & inner & ~before.rlike(letter) & ~after.rlike(letter)


def corrected(text: str, edits: list[tuple[int, int, str]]) -> str:
    """The text after edits in ascending order; one that begins before the last one's end is left out."""
    at, parts = 0, []
    for start, end, suggestion in edits:
        if start >= at:
            parts += [text[at:start], suggestion]
            at = end
    return "".join(parts) + text[at:]


def apply_corrections(docs: DataFrame, errors: DataFrame) -> DataFrame:
    """docs(doc_id, text) with errors(doc_id, start, end, suggestion) replaced.

    Of overlapping spans the one that begins first stays. The gaps between a document's edits are put together in one pass. Edits without place
    or suggestion count for nothing.
    """
    edits = errors.where("suggestion is not null and start is not null and end is not null").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "suggestion"))).alias("edits"))
    schema, at = docs.schema, docs.columns.index("text")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, texts = batch.column(batch.num_columns - 1), batch.column(at)
            fixed = [text.as_py() if not e.is_valid or not text.is_valid else corrected(text.as_py(), [(x["start"], x["end"], x["suggestion"]) for x in e.as_py()]) for text, e in zip(texts, own)]
            columns = [pa.array(fixed, pa.string()) if i == at else batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    # plain names: Spark reads a dot in the names of what is mapped
    joined = docs.join(edits, "doc_id", "left").select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)], "edits")
    return joined.mapInArrow(run, schema)


def carry_errors(old: DataFrame, new: DataFrame, errors: DataFrame, old_sents: DataFrame | None = None, new_sents: DataFrame | None = None) -> DataFrame:
    """Errors that survive an edit: before the common beginning as they are, after it moved by the change of length.

    Context errors stay only if their sentence is in the new text too.
    """
    pair = old.select("doc_id", F.col("text").alias("old")).join(new.select("doc_id", F.col("text").alias("new")), "doc_id")
    head = shared_head("old", "new")
    room = F.least(F.length("old"), F.length("new")) - F.col("head")
    pair = pair.withColumn("head", head).withColumn("tail", F.least(shared_head(F.reverse("old"), F.reverse("new")), room)).withColumn("shift", F.length("new") - F.length("old"))
    rows = errors.join(pair, "doc_id")
    stays, moves = F.col("end") <= F.col("head"), F.col("start") >= F.length("old") - F.col("tail")
    by = F.when(stays, 0).when(moves, F.col("shift"))
    rows = rows.withColumn("by", by).where("by is not null").withColumn("s", F.col("start") + F.col("by")).withColumn("e", F.col("end") + F.col("by"))
    rows = rows.where(error_still_matches(F.col("new"), F.col("s"), F.col("e"), F.col("word")))
    if old_sents is not None and new_sents is not None:
        kept = new_sents.select("doc_id", F.col("text").alias("sentence")).distinct()
        own = old_sents.select("doc_id", F.col("text").alias("sentence"), F.col("start").alias("ss"), F.col("end").alias("se"))
        same = own.join(kept, ["doc_id", "sentence"], "left_semi")
        ok = rows.join(same, "doc_id").where((F.col("start") >= F.col("ss")) & (F.col("start") < F.col("se"))).select("doc_id", "start").distinct()
        rows = rows.where("kind <> 'context'").unionByName(rows.where("kind = 'context'").join(ok, ["doc_id", "start"], "left_semi").select(rows.columns))
    columns = [F.col("s").alias("start") if c == "start" else F.col("e").alias("end") if c == "end" else F.col(c) for c in errors.columns]
    return rows.select(columns)


def split_entries(text: Column) -> Column:
    """Entries of bulk input: cut at separators, punctuation at the ends stripped."""
    return F.filter(F.transform(F.split(text, r"[\s,;]+"), lambda p: F.regexp_replace(p, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}'-]+$", "")), lambda p: p != "")


def update_user_lists(lists: DataFrame, changes: DataFrame) -> DataFrame:
    """lists(word, list_type) after changes(seq, action, text): add, remove, ignore, unignore.

    Of entries that are equal in any case the first stays; for each the last change decides.
    """
    kind = F.when(F.col("action").isin("add", "remove"), "user").otherwise("ignored")
    rows = changes.select("seq", "action", kind.alias("list_type"), F.posexplode(split_entries(F.col("text"))).alias("at", "word"))
    every = lists.select(F.lit(-1).cast("long").alias("seq"), F.lit(0).alias("at"), "list_type", "word", F.lit(True).alias("present")).union(rows.select(F.col("seq").cast("long"), "at", "list_type", "word", F.col("action").isin("add", "ignore")))
    own = Window.partitionBy("list_type", F.lower("word"))
    last = every.withColumn("r", F.row_number().over(own.orderBy(F.desc("seq"), F.desc("at"))))
    # the spelling is that of the first addition after the last removal
    gone = F.max(F.when(~F.col("present"), F.struct("seq", "at"))).over(own)
    first = last.withColumn("gone", gone).where(F.col("present") & (F.col("gone").isNull() | (F.struct("seq", "at") > F.col("gone"))))
    return first.withColumn("f", F.row_number().over(own.orderBy("seq", "at", "word"))).where("f = 1").select("word", "list_type")


def clear_word(errors: DataFrame, words: DataFrame) -> DataFrame:
    """Errors without those of words that were just accepted."""
    return errors.join(words.select("word"), "word", "left_anti")
