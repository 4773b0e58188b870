"""URL filters: a Bloom filter cascade gives exact membership of listed keys without joins.

A rule is a host and a path, written `example.org/es/`. It fits its host and all subdomains if
the url's path starts with the rule's path. A url therefore offers a small set of keys: each
suffix of its host followed by each prefix of its path that is as long as some rule's path.
The distinct keys of the corpus are the key universe. Level 1 of a cascade is a Bloom filter of
the listed keys, level 2 one of the universe's other keys that level 1 lets through, level 3 one
of the listed keys that level 2 lets through, and so on until a level lets nothing through that
it should not. Over the universe, the first level that rejects a key decides, without error.

Sizes: level 1 has `bits_per_key` bits for each listed key, later levels shrink with the false
positives; they follow the list, and enter the plan as binary literals. More than `max_bits` is
refused (ValueError), so nothing unbounded is shipped to tasks.

Defined results: null urls and urls without `://` have an empty host and path and fit no rule;
empty tables give an empty result; repeated pages are judged each; other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def candidate_keys(host: Column, path: Column, lengths: Sequence[int]) -> Column:
    """All keys under which a rule could fit this url."""
    parts = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    heads = F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]), lambda p: p.isNotNull())
    return F.flatten(F.transform(suffixes, lambda s: F.transform(heads, lambda p: F.concat(s, p))))


def _positions(key: Column, level: int, hashes: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level * 64 + j)), F.lit(bits)) for j in range(hashes)]


class Cascade:
    """levels: one byte (0 or 1) for each bit, so that a test is one byte of a binary literal."""

    def __init__(self, levels: list[tuple[bytes, int]]):
        self.levels = levels

    @property
    def bits(self) -> int:
        return sum(len(x) for x, _ in self.levels)

    def contains(self, key: Column) -> Column:
        def passes(i: int) -> Column:
            data, hashes = self.levels[i]
            out = F.lit(True)
            for p in _positions(key, i, hashes, len(data)):
                out = out & (F.substring(F.lit(bytearray(data)), (p + 1).cast("int"), F.lit(1)) == F.lit(bytearray(b"\x01")))
            return out

        verdict = F.lit(len(self.levels) % 2 == 1)  # nothing of the universe gets beyond the last level wrongly
        for i in reversed(range(len(self.levels))):
            verdict = F.when(passes(i), verdict).otherwise(F.lit(i % 2 == 1))
        return verdict


def build_cascade(listed: DataFrame, universe: DataFrame, bits_per_key: int = 16, hashes: int = 6, max_bits: int = 1 << 24, max_levels: int = 40) -> Cascade:
    """listed(key), universe(key), both distinct: a cascade exact over universe and listed."""
    inside, outside = listed, universe.join(listed, "key", "left_anti")
    levels: list[tuple[bytes, int]] = []
    while True:
        n = inside.count()
        if not n and levels:
            return Cascade(levels)
        bits = max(64, n * bits_per_key)
        if bits + sum(len(x) for x, _ in levels) > max_bits:
            raise ValueError(f"a cascade of more than {max_bits} bits; raise max_bits or shorten the list")
        # the positions set are at most `bits`, whatever the corpus holds
        marks = inside.select(F.explode(F.array(*_positions(F.col("key"), len(levels), hashes, bits))).alias("p")).distinct()
        data = bytearray(bits)
        for row in marks.toLocalIterator():
            data[row.p] = 1
        levels.append((bytes(data), hashes))
        if len(levels) > max_levels:
            raise RuntimeError("the cascade does not end; keys collide on every level")
        probe = Cascade(levels[:-1] + [levels[-1]])
        level = len(levels) - 1
        passing = F.lit(True)
        for p in _positions(F.col("key"), level, hashes, bits):
            passing = passing & (F.substring(F.lit(bytearray(probe.levels[level][0])), (p + 1).cast("int"), F.lit(1)) == F.lit(bytearray(b"\x01")))
        inside, outside = cut(outside.where(passing)), inside


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """rules: (verdict, host, path). One row per page: id, host, path, rule, verdict.

    The longest rule (host and path together) wins; of equally long ones the longer host. A url
    that no listed key fits gets `default`: the cascades reject all its keys.
    """
    spark = pages.sparkSession
    host, path = url_parts(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    lengths = sorted({len(p) for _, _, p in rules})
    keyed = urls.withColumn("keys", candidate_keys(F.col("host"), F.col("path"), lengths))
    universe = cut(keyed.select(F.explode("keys").alias("key")).distinct())
    cascades = {}
    for verdict in ("allow", "block"):
        own = [(h.translate(str.maketrans(UPPER, LOWER)) + p,) for v, h, p in rules if v == verdict]
        cascades[verdict] = build_cascade(spark.createDataFrame(sorted(set(own)), "key string"), universe)
    hit = F.filter(
        F.transform("keys", lambda k: F.struct(F.length(k).alias("n"), F.length(F.substring_index(k, "/", 1)).alias("h"), k.alias("key"),
                                               F.when(cascades["block"].contains(k), "block").when(cascades["allow"].contains(k), "allow").alias("verdict"))),
        lambda x: x["verdict"].isNotNull())
    best = keyed.withColumn("best", F.array_max(hit))
    return best.select("page_id", "host", "path", F.col("best.key").alias("rule"), F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"))
