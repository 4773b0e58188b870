"""Embedding near-dedup by NN-descent within labels.

Equal vectors of a label are one class, so only different vectors enter the graph.

1. Start: `tables` times, the classes of a label are cut into groups by the signs of random
   projections and each group into blocks of at most `block` rows; within a block every class
   takes its best `k` neighbours.
2. Descent: each class meets the neighbours of its neighbours. For a class and its forward and
   reverse neighbours the local join compares all of them with each other and offers each one its
   best; lists keep the best `k`. A class comes with the cosine of its list's last entry, so that
   only offers that can enter the list leave the join. Rounds end when few entries change. Reverse lists are bounded by
   drawing from them with a hash, as the method has it; what is lost there only delays a pair.
   Vectors travel in half precision: that is enough to rank neighbours.
3. Enlarging: a list full of links (cosine >= threshold) may hide more. Such saturated lists are
   doubled and the descent goes on around them alone, until no list is saturated or lists hold
   `widest` entries. Only links are offered there, drawn from those that a centre knows, and none to
   a list that is full again; entries further than two links apart take no part, since what they
   lead to is no link. Classes saturated even then have more links than a list should hold: they
   become a stated query set that is compared with all classes of their label, in blocks, exactly;
   a block sends back numbers of links and a spanning forest, never the pairs.
4. Audit: one class in `audit` is compared exactly the same way, and the recall of the graph's
   links on it, enlarged lists included, is reported. If it is below `least_recall`, all lists are
   doubled and the descent goes on; after `max_rounds` such steps every class becomes a query.
5. Links are the graph's edges at or above the threshold, from either side. All edges that half
   precision does not put clearly below it are computed again in double precision.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and
null labels, link with nothing and are kept; rows with equal vectors and label link with each
other; vectors of different length have no cosine and do not link; a null vec_id is kept but is
never a component's id if another row has one; an empty table gives an empty result; other columns
are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, cut, no_rows

FOUND = "u long, v long, sim double"
SHORT = "<f2"
MARGIN = 2e-3  # a cosine of vectors in half precision is off by less


def _unit(blobs, kind: str = "<f8") -> np.ndarray:
    x = np.frombuffer(b"".join(blobs), kind).reshape(len(blobs), -1)
    return x.astype(np.float32) if kind == SHORT else x


def _normalized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        blobs, shorts, dims = [], [], []
        for x in batch.column(2).to_pylist():
            v = None
            if x and None not in x:
                v = np.asarray(x, np.float64)
                top = np.abs(v).max()
                if not np.isfinite(top) or top == 0:
                    v = None
                else:
                    v = v / top  # neither overflow nor underflow in the norm
                    v = v / np.sqrt(v @ v)
            blobs.append(None if v is None else v.astype("<f8").tobytes())
            shorts.append(None if v is None else v.astype(SHORT).tobytes())
            dims.append(None if v is None else len(v))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(blobs, pa.binary()), pa.array(shorts, pa.binary()), pa.array(dims, pa.int32())], ["vec_id", "label", "unit", "short", "dim"])


def _best(sim: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a square of similarities, the k best others of each row."""
    sim = sim.copy()
    np.fill_diagonal(sim, -2.0)
    k = min(k, len(ids) - 1)
    top = np.argpartition(-sim, k - 1, axis=1)[:, :k]
    return np.repeat(ids, k), ids[top].ravel(), np.take_along_axis(sim, top, 1).ravel()


def _start(k: int, block: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        x, ids = _unit(group["short"].tolist(), SHORT), group["node"].to_numpy()
        if len(ids) < 2:
            return no_rows("u", "v", "sim")
        u, v, s = _best(x @ x.T, ids, k)
        return pd.DataFrame({"u": u, "v": v, "sim": s})

    return run


def _local_join(k: int, kind: str = "<f8", least: float | None = None, seed: int = 0):
    """Rows (u, node, unit, wide), sorted by u: the neighbours of a centre u, both ways, meet each other.

    wide: how many a class with an enlarged list is offered; -1 in all rows while no list is enlarged.
    With least, enlarged lists are offered others at or above it only, at most k, drawn at random.
    A column bound, where there is one, holds the least cosine that can still enter the class's list.
    """

    def drawn(u: int, ids: np.ndarray, x: np.ndarray, wide: np.ndarray) -> tuple | None:
        open_ = np.flatnonzero(wide > 0)
        sim = x[open_] @ x.T
        draw = np.random.default_rng([seed, u & (1 << 63) - 1]).random(sim.shape)
        draw[(sim < least) | (ids[open_][:, None] == ids[None, :])] = 2.0
        top = np.argpartition(draw, min(k, len(ids)) - 1, axis=1)[:, :k]
        good = np.take_along_axis(draw, top, 1) < 2.0
        return np.repeat(ids[open_], good.sum(1)), ids[top[good]], np.take_along_axis(sim, top, 1)[good]

    def offers(centre: int, ids: np.ndarray, units: list[bytes], wide: np.ndarray, bound: np.ndarray | None) -> tuple | None:
        most = int(wide.max())
        if len(ids) < 2 or most == 0:
            return None
        x = _unit(units, kind)
        if most > 0 and least is not None:
            return drawn(centre, ids, x, wide)
        each = min(most if most > 0 else max(2, k // 2), len(ids) - 1)
        u, v, s = _best(x @ x.T, ids, each)
        mine = np.repeat((wide > 0) | (most < 0), each)
        if bound is not None:
            mine &= s >= np.repeat(bound, each)
        return u[mine], v[mine], s[mine]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, units = None, []

        def meet(bounds) -> Iterator[pa.RecordBatch]:
            found = [offers(int(held[0][i]), held[1][i:j], units[i:j], held[2][i:j], held[3][i:j] if len(held) > 3 else None) for i, j in bounds]
            found = [x for x in found if x is not None]
            if found:
                u, v, s = (np.concatenate(c) for c in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(s.astype(np.float64))], ["u", "v", "sim"])

        for batch in batches:
            own = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("u", "node", "wide", "bound") if c in batch.schema.names]
            held = own if held is None else [np.concatenate(h) for h in zip(held, own)]
            units = units + batch.column("unit").to_pylist()
            at = [0, *(np.flatnonzero(np.diff(held[0])) + 1).tolist()]
            yield from meet(zip(at, at[1:]))
            held, units = [h[at[-1]:] for h in held], units[at[-1]:]  # the last centre may go on
        if units:
            yield from meet([(0, len(units))])

    return run


def _keep_best(edges: DataFrame, k: int, wide: DataFrame | None = None) -> DataFrame:
    """The k best entries of each list, of those in wide(u, wide) as many as stand there; fresh: 0 if the list had the entry before."""
    # one shuffle serves the duplicates and the lists
    edges = edges.repartition("u").groupBy("u", "v").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v"))
    most = F.lit(k)
    if wide is not None:
        edges, most = edges.join(wide, "u", "left"), F.coalesce("wide", F.lit(k))
    return edges.withColumn("r", rank).where(F.col("r") <= most).select("u", "v", "sim", "fresh")


def _exact(queries: DataFrame, base: DataFrame, threshold: float, rows: int = 1024) -> DataFrame:
    """queries, base (node, group, unit, size): per pair of blocks, each query's links and a spanning forest.

    Rows (u, n, v): query u has n links (rows counted by class size, itself excluded) in a block;
    (u, 0, v): an edge of the forest.
    """
    def parts(df: DataFrame) -> DataFrame:
        n = df.groupBy("group").agg(F.count("*").alias("rows"))
        return df.join(n, "group").withColumn("part", F.pmod(F.xxhash64("node"), F.ceil(F.col("rows") / rows)))

    def blocks(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("group", F.col("part").alias(f"{name}_part")).agg(F.collect_list(F.struct("node", "size", "unit")).alias(name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q, b in zip(batch.column(0), batch.column(1)):
                q, b = q.as_py(), b.as_py()
                qi, bi = np.array([r["node"] for r in q]), np.array([r["node"] for r in b])
                hit = _unit([r["unit"] for r in q]) @ _unit([r["unit"] for r in b]).T >= threshold
                hit &= qi[:, None] != bi[None, :]
                number = hit @ np.array([r["size"] for r in b], np.int64)
                one = np.flatnonzero(hit.any(1))
                u, n, v = [qi], [number], [qi]
                parent = {}

                def root(x):
                    while parent.setdefault(x, x) != x:
                        parent[x] = parent[parent[x]]
                        x = parent[x]
                    return x

                forest = []
                for i in one.tolist():
                    for j in np.flatnonzero(hit[i]).tolist():
                        r, s = root(int(qi[i])), root(int(bi[j]))
                        if r != s:
                            parent[max(r, s)] = min(r, s)
                            forest.append((int(qi[i]), int(bi[j])))
                if forest:
                    f = np.array(forest, np.int64)
                    u.append(f[:, 0]), n.append(np.zeros(len(f), np.int64)), v.append(f[:, 1])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (u, n, v)], ["u", "n", "v"])

    asked, held = parts(queries), parts(base)
    # numbers of blocks are paired first; the blocks themselves meet in a task for each pair
    dealt = asked.select("group", F.col("part").alias("q_part")).distinct().join(held.select("group", F.col("part").alias("b_part")).distinct(), "group")
    dealt = dealt.repartition("group", "q_part", "b_part")
    pairs = dealt.join(blocks(asked, "q"), ["group", "q_part"]).join(blocks(held, "b"), ["group", "b_part"])
    spread = F.xxhash64("group", "q_part", "b_part")
    return pairs.select("q", "b", spread.alias("h")).repartition("h").select("q", "b").mapInArrow(run, "u long, n long, v long")


def neighbour_graph(nodes: DataFrame, k: int, rounds: int, tables: int, block: int, start: DataFrame | None = None, seed: int = 11) -> DataFrame:
    """nodes(node, group, dim, unit, n) -> (u, v, sim): lists of the k best neighbours found."""
    spark = nodes.sparkSession
    if start is None:
        rng = np.random.default_rng(seed)
        planes = rng.normal(size=(tables, 24, 4096)).astype(np.float32)

        def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = batch.num_rows
                units, count = batch.column(2).to_pylist(), batch.column(3).to_numpy()
                code = np.zeros((n, tables), np.int64)
                for i, blob in enumerate(units):
                    x = np.frombuffer(blob, "<f8")
                    take = np.resize(np.arange(4096), len(x))
                    bits = min(24, max(0, int(np.log2(max(1, count[i]) / (block / 4)))))
                    side = planes[:, :bits, take] @ x > 0
                    code[i] = side @ (1 << np.arange(bits, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code.tolist(), pa.list_(pa.int64()))], ["node", "group", "codes"])

        coded = nodes.select("node", "group", "unit", "n").mapInArrow(codes, "node long, group long, codes array<long>")
        placed = cut(coded.select("node", "group", F.posexplode("codes").alias("table", "code")))
        size = placed.groupBy("group", "table", "code").agg(F.count("*").alias("m"))
        placed = placed.join(size, ["group", "table", "code"])
        # crowded groups are dealt to blocks by hash, differently in each table
        placed = placed.withColumn("part", F.pmod(F.xxhash64("node", "table"), F.ceil(F.col("m") / block)))
        placed = placed.select("node", F.xxhash64("group", "table", "code", "part").alias("cell")).join(nodes.select("node", "short", "group"), "node")
        start = placed.groupBy("group", "cell").applyInPandas(_start(k, block), FOUND)
        start = _keep_best(start.withColumn("fresh", F.lit(1)), k)
    return descend(cut(start), nodes, k, rounds)


def descend(edges: DataFrame, nodes: DataFrame, k: int, rounds: int, wide: DataFrame | None = None, least: float = -2.0) -> DataFrame:
    """Better lists from neighbours' neighbours; with wide(u, wide) only the lists named there change, and hold that many, from `least` on."""
    vectors = nodes.select(F.col("node").alias("v"), F.col("short").alias("unit"))
    for i in range(rounds):
        back = edges.select(F.col("v").alias("u"), F.col("u").alias("v"), F.xxhash64("u", "v", F.lit(i)).alias("h"))
        back = back.withColumn("r", F.row_number().over(Window.partitionBy("u").orderBy("h"))).where(F.col("r") <= k).select("u", "v")
        around = edges.select("u", "v").union(back)
        around = around.union(around.select("u", F.col("u").alias("v"))).repartition("v").dropDuplicates(["u", "v"])
        lists = edges.groupBy(F.col("u").alias("v")).agg(F.count("*").alias("m"), F.min("sim").alias("low"))
        if wide is not None:
            # a full list is offered nothing, and centres without an open one around them have nothing to offer
            named = wide.withColumnRenamed("u", "v").join(lists, "v", "left").where(F.coalesce("m", F.lit(0)) < F.col("wide")).select("v", "wide")
            around = around.join(around.join(named, "v", "left_semi").select("u").distinct(), "u", "left_semi").join(named, "v", "left")
            around = around.select("u", "v", F.coalesce("wide", F.lit(0)).cast("long").alias("wide")).join(vectors, "v")
            local, join = around.select("u", F.col("v").alias("node"), "unit", "wide"), _local_join(k, SHORT, least, i)
        else:
            bound = F.when(F.col("m") >= k, F.col("low")).otherwise(F.lit(-2.0))
            known = vectors.join(lists, "v", "left").select("v", "unit", bound.alias("bound"))
            local = around.join(known, "v").select("u", F.col("v").alias("node"), "unit", F.lit(-1).cast("long").alias("wide"), "bound")
            join = _local_join(k, SHORT)
        offers = local.repartition("u").sortWithinPartitions("u", "node").mapInArrow(join, FOUND)
        both = edges.withColumn("fresh", F.lit(0)).union(offers.withColumn("fresh", F.lit(1)))
        edges = cut(_keep_best(both, k, wide))
        changed, total = edges.agg(F.coalesce(F.sum("fresh"), F.lit(0)), F.count("*")).first()
        if changed <= 0.002 * total:
            break
    return edges


def enlarge(edges: DataFrame, nodes: DataFrame, k: int, widest: int, threshold: float, rounds: int) -> tuple[DataFrame, DataFrame]:
    """Double saturated lists up to `widest`: the edges, and (u) of the lists that are full of links even then."""
    least = threshold - MARGIN
    # two classes that link with a third are at most twice the angle apart
    apart = 2 * least * least - 1 - MARGIN if least > 0 else -2.0
    rest, close = edges.where(F.col("sim") < apart), cut(edges.where(F.col("sim") >= apart))
    wide, most = None, k
    while True:
        links = close.where(F.col("sim") >= least).groupBy("u").agg(F.count("*").alias("m"))
        full = cut(links.where(F.col("m") >= most).select("u"))
        if most >= widest or full.isEmpty():
            return close.union(rest), full
        most *= 2
        now = full.withColumn("wide", F.lit(most))
        # lists that were enlarged before and are no longer full keep their length
        wide = cut(now if wide is None else now.union(wide.join(full, "u", "left_anti")))
        close = descend(close, nodes, k, rounds, wide, least)


def _verified(graph: DataFrame, full: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(u, v), u < v: the graph's links, in double precision; without those between two of full(u), which are counted elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sim = [float(np.frombuffer(x, "<f8") @ np.frombuffer(y, "<f8")) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield batch.filter(pa.array([s >= threshold for s in sim], pa.bool_())).select([0, 1])

    pairs = graph.where(F.col("sim") >= threshold - MARGIN).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    mark = full.withColumn("full", F.lit(True))
    pairs = pairs.join(mark.toDF("u", "uf"), "u", "left").join(mark.toDF("v", "vf"), "v", "left").where("uf is null or vf is null").select("u", "v")
    units = nodes.select("node", "unit")
    return pairs.join(units.toDF("u", "x"), "u").join(units.toDF("v", "y"), "v").select("u", "v", "x", "y").mapInArrow(run, "u long, v long")


def near_vector_classes(table: DataFrame, threshold: float = 0.93, k: int = 16, rounds: int = 4, tables: int = 6, block: int = 128, least_recall: float = 0.95, max_rounds: int = 2, audit: int = 20, widest: int = 128) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept, recall (of the audited classes)."""
    spark = table.sparkSession
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = cut(rows.mapInArrow(_normalized, "vec_id long, label long, unit binary, short binary, dim int").withColumn("key", F.sha2("unit", 256)))
    good = rows.where("unit is not null and label is not null")
    classes = good.groupBy("label", "dim", "key").agg(F.count("*").alias("size"), F.min("vec_id").alias("least"), F.first("unit").alias("unit"), F.first("short").alias("short"))
    group = F.xxhash64("label", "dim")
    # a class without any vec_id gets a number of its own, above all ids
    node = F.coalesce("least", F.lit(1 << 62).bitwiseOR(F.shiftrightunsigned(F.xxhash64("label", "key"), 2)))
    nodes = classes.select(node.alias("node"), group.alias("group"), "dim", "unit", "short", "size", "least", "label", "key")
    nodes = cut(nodes.join(nodes.groupBy("group").agg(F.count("*").alias("n")), "group"))
    if nodes.isEmpty():
        links = spark.createDataFrame([], "u long, v long")
        recall, exact = 1.0, spark.createDataFrame([], "u long, n long, v long")
    else:
        audited = nodes.where(F.pmod(F.xxhash64("node", F.lit(3)), F.lit(audit)) == 0)
        truth = cut(_exact(audited, nodes, threshold))
        graph, recall = None, 0.0
        for i in range(max_rounds + 1):
            graph = neighbour_graph(nodes, k, rounds, tables, block, graph)
            graph, full = enlarge(graph, nodes, k, widest, threshold, rounds)
            links = cut(_verified(graph, full, nodes, threshold))
            saturated = cut(nodes.join(full.withColumnRenamed("u", "node"), "node", "left_semi"))
            both = links.select("u", "v").union(links.select("v", "u")).distinct()
            sizes = nodes.select(F.col("node").alias("v"), "size")
            have = both.join(sizes, "v").groupBy("u").agg(F.sum("size").alias("have"))
            want = truth.groupBy("u").agg(F.sum("n").alias("want")).where("want > 0").join(full, "u", "left_anti")
            got = want.join(have, "u", "left").agg(F.sum(F.coalesce("have", F.lit(0))).alias("have"), F.sum("want").alias("want")).first()
            recall = 1.0 if not got.want else got.have / got.want
            if recall >= least_recall:
                break
            k *= 2
        asked = saturated if recall >= least_recall else nodes
        exact = cut(_exact(asked, nodes, threshold).union(truth.join(asked.select(F.col("node").alias("u")), "u", "left_anti")))
    both = links.union(links.select("v", "u")).distinct()
    # a class that was asked exactly has its number from there, another one from the graph and from the forests
    asked_n = exact.groupBy("u").agg(F.sum("n").alias("sum_n"))
    edges = cut(both.union(exact.where("u <> v").select("u", "v")).union(exact.where("u <> v").select("v", "u")).distinct())
    seen = edges.join(nodes.select(F.col("node").alias("v"), "size"), "v").groupBy("u").agg(F.sum("size").alias("seen"))
    comp = components(edges.select(F.col("u").alias("a"), F.col("v").alias("b")))
    info = nodes.join(asked_n.withColumnRenamed("u", "node"), "node", "left").join(seen.withColumnRenamed("u", "node"), "node", "left").join(comp, "node", "left")
    info = info.select("label", "dim", "key", "least", "size", F.coalesce("comp", "node").alias("comp"), F.coalesce("sum_n", "seen", F.lit(0)).alias("others"))
    ids = info.groupBy("comp").agg(F.min("least").alias("component_id"))
    info = info.join(ids, "comp").select("label", "dim", "key", "component_id", (F.col("others") + F.col("size") - 1).alias("n_links"))
    out = rows.select("vec_id", "label", "dim", "key").join(info, ["label", "dim", "key"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"), F.lit(float(recall)).alias("recall"))
