"""Token counts by dynamic programming over tries of pre-tokens.

Each task keeps a trie of the pre-tokens it has met. A node holds the best unigram score of its
prefix and the number of pieces on that best path, computed once for all pre-tokens that share
the prefix; a document's count is the sum of the counts at its pre-tokens' last nodes. Nothing is
shuffled, and a frequent word or source costs no more than a rare one; a full trie is emptied and
grows anew, which changes no count.

Pre-tokens are the runs of characters other than white space, each with one separator before it.

Defined results: null, empty and white texts have 0 words and tokens; rows that repeat are
counted each; an empty table gives an empty result; other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lattice import DEFAULT_MODEL, CountTrie, vocabulary

SCHEMA = "doc_id long, n_words long, n_tokens long, n_byte_tokens long"


def token_counts(docs: DataFrame, model: str = DEFAULT_MODEL, max_nodes: int = 600_000) -> DataFrame:
    """One row per document: doc_id, n_words, n_tokens, n_byte_tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = CountTrie(vocabulary(model), max_nodes)
        of = trie.tokens
        for batch in batches:
            words, tokens, spelled = [], [], []
            for text in batch.column(1):
                found = (text.as_py() or b"").split()
                pairs = list(map(of, found))
                words.append(len(found))
                tokens.append(sum(p[0] for p in pairs))
                spelled.append(sum(p[1] for p in pairs))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64()), pa.array(spelled, pa.int64())], ["doc_id", "n_words", "n_tokens", "n_byte_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(count, SCHEMA)
