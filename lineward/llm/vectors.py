"""Near-duplicate vectors of a label: all pairs by cosine, compared in tiles along principal components.

Vectors are turned so that the directions of most variance come first. A tile accumulates the leading
dimensions of its products first; what the other dimensions can add is at most the product of the two
suffix norms, so most pairs are settled without them. Only pairs that can still reach the threshold are
finished, and those within rounding of it are decided on the original numbers.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineward.llm.common import components, joined_to_groups, written

THRESHOLD = 0.93
#: Vectors of a block; two blocks are compared by one task.
BLOCK = 2048
_LEAD, _TILE, _SLACK = 16, 512, 1e-9


def _axes(unit: DataFrame, size: int) -> np.ndarray:
    """Principal axes as columns, by falling variance, from the sums of products over all vectors."""

    def products(batches):
        total = np.zeros((size, size))
        for pdf in batches:
            x = np.stack(pdf["unit"].to_numpy())
            if x.shape[1] == size:
                total += x.T @ x
        yield pd.DataFrame({"product": [total.ravel().tolist()]})

    parts = unit.where(F.size("unit") == size).select("unit").mapInPandas(products, "product array<double>")
    sums = parts.select(F.posexplode("product").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v"))
    found = sums.orderBy("at").toPandas()["v"].to_numpy()  # size * size numbers
    if len(found) != size * size:
        return np.eye(size)
    return np.ascontiguousarray(np.linalg.eigh(found.reshape(size, size))[1][:, ::-1])


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision on the numbers as they came."""
    return np.einsum("ij,ij->i", a, b) / np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b))


def tile_links(ua, ub, va, vb, threshold: float, axes: np.ndarray | None = None):
    """(rows, columns) of all pairs of ``ua`` and ``ub`` with a cosine of the threshold or more.

    ``ua`` and ``ub`` are unit vectors along the axes, ``va`` and ``vb`` the original vectors.
    """
    rows, cols = [], []
    lead = min(_LEAD, ua.shape[1])
    rest_a, rest_b = (np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", u[:, :lead], u[:, :lead]))) for u in (ua, ub))
    for i in range(0, len(ua), _TILE):
        for j in range(0, len(ub), _TILE):
            part = ua[i:i + _TILE, :lead] @ ub[j:j + _TILE, :lead].T
            r, c = np.nonzero(part + rest_a[i:i + _TILE, None] * rest_b[None, j:j + _TILE] >= threshold - _SLACK)
            if len(r):
                full = part[r, c] + np.einsum("ij,ij->i", ua[i + r, lead:], ub[j + c, lead:])
                near = full >= threshold - _SLACK
                r, c = i + r[near], j + c[near]
                sure = _cosines(va[r], vb[c]) >= threshold
                rows.append(r[sure])
                cols.append(c[sure])
    return (np.concatenate(rows), np.concatenate(cols)) if rows else (np.zeros(0, np.int64),) * 2


def forest(n: int, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node it is connected with by the links."""
    root = np.arange(n)
    while len(rows):
        a, b = root[rows], root[cols]
        apart = a != b
        if not apart.any():
            break
        rows, cols, a, b = rows[apart], cols[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def _comparing(axes, threshold: float):
    """Compares the two blocks of a group: link counts and a forest of the links, for the vectors that have any."""

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        same = pdf["left"].iloc[0] == pdf["right"].iloc[0]
        a = pdf[pdf["block"] == pdf["left"]].reset_index(drop=True)
        b = a if same else pdf[pdf["block"] == pdf["right"]].reset_index(drop=True)
        empty = pd.DataFrame({"node": [], "links": [], "root": []}).astype("int64")
        if a.empty or b.empty:
            return empty
        va, vb = np.stack(a["v"].to_numpy()), np.stack(b["v"].to_numpy())
        ua, ub = np.stack(a["unit"].to_numpy()) @ axes.value, np.stack(b["unit"].to_numpy()) @ axes.value
        r, c = tile_links(ua, ub, va, vb, threshold)
        if same:
            r, c = r[r < c], c[r < c]
        nodes = np.concatenate([a["node"], b["node"]])
        links = np.zeros(len(nodes), np.int64)
        np.add.at(links, r, b["copies"].to_numpy()[c])
        np.add.at(links, len(a) + c, a["copies"].to_numpy()[r])
        # In one block, row i of the right side is row i of the left side.
        tree = forest(len(nodes), r, (c if same else len(a) + c))
        if same:
            tree[len(a):] = tree[:len(a)]
        own = np.flatnonzero((links > 0) | (np.arange(len(nodes)) != tree))
        return pd.DataFrame({"node": nodes[own], "links": links[own], "root": nodes[tree[own]]})

    return compare


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of ``vectors(vec_id, embedding, label)``.

    Vectors of equal, non-null label link at a cosine of ``threshold`` or more; those that are null, empty,
    zero or hold null or non-finite numbers link with nothing, and neither do vectors of different lengths.
    Equal vectors of a label are compared once and counted as often as they are there: a large group of
    copies costs no pairs, and every task emits link counts and a forest, never pairs. Rows that repeat a
    vec_id link like any others and take the component of that id; a null vec_id counts as a link to the
    others but is in no component.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"),
                          F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    usable = F.coalesce(F.col("label").isNotNull() & ~bad & (norm > 0) & (norm < float("inf")), F.lit(False))
    rows = written(rows.withColumn("ok", usable).withColumn("class_key", F.when(usable, F.sha2(F.concat_ws(
        ",", F.col("label").cast("string"), F.transform("v", lambda x: (x + F.lit(0.0)).cast("string"))), 256))), "vectors")
    classes = rows.where("ok").groupBy("class_key").agg(
        F.first("label").alias("label"), F.first("v").alias("v"), F.count("*").alias("copies"), F.min("vec_id").alias("low"))
    scale = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    classes = classes.withColumn("scale", scale).withColumn("unit", F.expr("transform(v, x -> x / scale)")).withColumn(
        "node", F.monotonically_increasing_id())
    classes = written(classes, "classes")

    sizes = [r[0] for r in classes.select(F.size("unit")).distinct().collect()]  # lengths of vectors
    counts, edges = [], []
    for size in sizes:
        axes = spark.sparkContext.broadcast(_axes(classes, size))
        own = classes.where(F.size("unit") == size)
        # Blocks of a label, at random; as many as its vectors need, each pair of them one group.
        blocks = own.groupBy("label").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
        own = own.join(blocks, "label").withColumn("block", F.pmod(F.xxhash64("class_key"), F.col("blocks")))
        # Block b meets block c once, as (b, c) with b <= c.
        pairs = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
            "label", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"),
            "block", "node", "copies", "v", "unit")

        found = written(pairs.groupBy("label", "left", "right").applyInPandas(_comparing(axes, threshold), "node long, links long, root long"), "links")
        counts.append(found.groupBy("node").agg(F.sum("links").alias("links")))
        edges.append(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).distinct())
    if not sizes:
        nothing = spark.createDataFrame([], "node long, links long")
        counts, edges = [nothing], [nothing.select(F.col("node").alias("a"), F.col("links").alias("b"))]
    links, joined = counts[0], edges[0]
    for more, others in zip(counts[1:], edges[1:]):
        links, joined = links.union(more), joined.union(others)

    placed = components(joined)
    named = classes.select("node", "class_key", "copies", "low").join(links, "node", "left").join(placed, "node", "left")
    named = written(named.withColumn("component", F.coalesce("component", "node")), "named")
    lowest = written(named.groupBy("component").agg(F.min("low").alias("component_id"), F.count("*").alias("n")), "lowest")
    named = written(joined_to_groups(named, lowest, ["component"], "n", named.count()).select(
        "class_key", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id", "copies"), "named")
    out = rows.select("vec_id", "class_key")
    some = out.where("class_key is not null")
    out = joined_to_groups(some, named, ["class_key"], "copies", rows.count()).drop("copies").unionByName(
        out.where("class_key is null"), allowMissingColumns=True)
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      F.when(F.col("vec_id").isNotNull(), component).alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
