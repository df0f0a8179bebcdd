"""Pairwise matches -> groups: connected components over a two-dimensional grid of edge blocks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fixloom.operators.skew import salted_join
from fixloom.runtime import written

EDGES_PER_CELL, LEAST_PER_CELL = 400_000, 500


def union_find(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Smallest member of the component of each of ``n`` numbered vertices; hooks and pointer jumps on whole arrays."""
    parent = np.arange(n)
    while len(u):
        a, b = parent[u], parent[v]
        open_ = a != b
        u, v, a, b = u[open_], v[open_], a[open_], b[open_]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
    return parent


def _cell(pdf: pd.DataFrame) -> pd.DataFrame:
    codes, names = pd.factorize(pd.concat([pdf["u"], pdf["v"]], ignore_index=True))
    order = np.argsort(names.to_numpy(object) if hasattr(names, "to_numpy") else names)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    half = len(pdf)
    root = union_find(rank[codes[:half]], rank[codes[half:]], len(order))
    sorted_names = np.asarray(names, object)[order]
    return pd.DataFrame({"vertex": sorted_names, "rep": sorted_names[root]})


def _cells(edges: DataFrame, n: int, per_cell: int) -> tuple[DataFrame, int]:
    """Edges with the grid cell they belong to. A cell above ``per_cell`` edges is cut, as any cut of the edges will do."""
    side = max(1, math.ceil((math.sqrt(8 * n / per_cell + 1) - 1) / 2))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(side))
    row, column = F.least(block("u"), block("v")), F.greatest(block("u"), block("v"))
    placed = edges.withColumn("cell", row * side + column)
    if side == 1:
        return placed, 1
    sizes = {r[0]: r[1] for r in placed.groupBy("cell").count().where(F.col("count") > 2 * per_cell).collect()}  # at most n / per_cell
    if sizes:
        cuts = F.create_map(*(F.lit(x) for c, k in sizes.items() for x in (c, math.ceil(k / per_cell))))
        cut = F.pmod(F.xxhash64("u", "v", F.lit(7)), F.coalesce(cuts[F.col("cell")], F.lit(1)))
        placed = placed.withColumn("cell", F.col("cell") + cut * (side * side))
    return placed, side * (side + 1) // 2 + sum(math.ceil(k / per_cell) for k in sizes.values())


def connected_components(edges: DataFrame, src: str, dst: str, per_cell: int | None = None) -> DataFrame:
    """``vertex, root`` for every vertex that an edge links to another; ``root`` is the smallest vertex of its group.

    Vertices hash into blocks, an edge lies in the cell of its two blocks, so the edges of a hub with a third of all
    edges spread over a whole row of cells (and a cell that is still too large is cut). Every cell runs union-find on
    its own edges and names a representative, its smallest, for each of its vertices. A vertex that got several
    representatives from the cells of its row and column links them: these links are the next, smaller graph. When a
    graph fits one cell its parents are stable, and the rounds are followed back to the first vertices. Chains
    shrink by at least a third each round, so long ones need logarithmically many. Each round is a table in the
    shared folder; only edge counts (and sizes of over-full cells) come to the driver. A cell takes the edges of one
    task (all edges over the parallelism of the session, between 500 and 400,000), if ``per_cell`` does not say otherwise.

    NULL ends and self links link nothing and are left out; repeated and turned edges count once. Strings compare by
    bytes. Empty input gives no rows.
    """
    kind = edges.select(src).schema[0].dataType
    schema = T.StructType([T.StructField("vertex", kind), T.StructField("rep", kind)])
    links = edges.select(F.least(src, dst).alias("u"), F.greatest(src, dst).alias("v"), F.col(src).alias("_a"), F.col(dst).alias("_b"))
    links = written(links.where("_a IS NOT NULL AND _b IS NOT NULL AND u <> v").select("u", "v").distinct(), "edges")
    parents: list[DataFrame] = []
    if per_cell is None:
        per_cell = min(max(-(-links.count() // edges.sparkSession.sparkContext.defaultParallelism), LEAST_PER_CELL), EDGES_PER_CELL)
    while True:
        n = links.count()
        placed, cells = _cells(links, n, per_cell)
        reps = placed.groupBy("cell").applyInPandas(_cell, schema)
        if cells == 1:
            root = reps.toDF("vertex", "root")
            break
        reps = written(reps, "reps")
        parent = written(reps.groupBy("vertex").agg(F.min("rep").alias("parent"), F.max("rep").alias("_last")), "parents")
        parents.append(parent.select("vertex", "parent"))
        several = parent.where(F.col("parent") != F.col("_last")).select("vertex", "parent")
        links = written(reps.join(several, "vertex").where(F.col("rep") != F.col("parent")).select(F.col("parent").alias("u"), F.col("rep").alias("v")).distinct(), "edges")
    for parent in reversed(parents):
        above = written(root.toDF("parent", "root"), "roots")
        root = _follow(parent, above)
    return root


def _follow(parent: DataFrame, above: DataFrame) -> DataFrame:
    joined = salted_join(parent, above, "parent", F.col("vertex"))  # the root of a giant group is a hot key
    return joined.select("vertex", F.coalesce("root", "parent").alias("root"))


def group_members(edges: DataFrame, src: str, dst: str, per_cell: int | None = None) -> DataFrame:
    """``group, member`` for each distinct non-NULL value of ``src`` or ``dst``, lone ones included."""
    ends = edges.select(F.explode(F.array(src, dst)).alias("member")).where(F.col("member").isNotNull()).distinct()
    roots = connected_components(edges, src, dst, per_cell)
    joined = ends.join(roots, ends["member"] == roots["vertex"], "left")
    return joined.select(F.coalesce("root", "member").alias("group"), "member")


def group_report(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """``group, n_members`` for each group, largest ones included whole."""
    return group_members(edges, src, dst).groupBy("group").agg(F.count(F.lit(1)).alias("n_members"))

