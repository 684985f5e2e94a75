"""Exact near-duplicate vectors by a metric range join (operator 10).

Distance is the angle between vectors, so cosine >= c is a range join of radius
theta = acos(c).  Equal vectors form one class first (partial aggregation), so a
very common vector is one point.

Pivots partition the points: a point lives in the cell of its nearest pivot.  If
x of cell i and y of cell j are within theta, the triangle inequality gives
angle(x, p_j) <= angle(x, p_i) + 2 theta, and, as the mid-plane of the two pivots
runs between x and y, x lies within theta of that plane.  x is replicated to every
later cell for which both hold, so each pair meets in exactly one cell and the
cells join independently.

A cell is joined in tiles of bounded blocks; a tile multiplies two blocks in
double precision and emits one row per linked member (its number of links and the
smallest member it reaches inside the tile), never the pairs.  Components close
over these rows.

Pivots come from a bounded sample of points (PIVOT_SAMPLE, by hash of the id);
every point is assigned and joined.  Where vectors are spread evenly over many
dimensions, angles between them are nearly equal, hardly any cell can be ruled
out, and the join does the work of all blocks against all blocks.

Defined results: vectors that are null, empty, zero, or hold a null or non-finite
component have no links and are their own component.  Vectors of different
sizes are not linked.  A row with a null id links with nothing, its component is
null and it is kept.  Rows count one by one, so repeated rows link with each
other; rows that share an id are one node of the components.  An empty table gives
an empty result; columns besides the id and the vector are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qaframe.llm.common import stage, workdir
from qaframe.llm.components import components

PIVOT_SAMPLE = 4096
MAX_PIVOTS = 256
BLOCK = 4096


def unit(rows) -> np.ndarray:
    """Rows of equal size as unit vectors in double precision."""
    x = np.stack([np.asarray(r, dtype=np.float64) for r in rows])
    x /= np.abs(x).max(axis=1, keepdims=True)      # no overflow or underflow of squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def choose_pivots(sample: list, per_dim: dict[int, int], cosine: float) -> dict[int, np.ndarray]:
    """Unit pivots per vector size: sample points that are not near-duplicates of each other."""
    out = {}
    for dim, wanted in per_dim.items():
        rows = [r for r in sample if len(r) == dim]
        if not rows:
            continue
        x = unit(rows)
        chosen = [0]
        for i in range(1, len(x)):
            if len(chosen) >= wanted:
                break
            if (x[chosen] @ x[i]).max() < cosine:
                chosen.append(i)
        out[dim] = x[chosen]
    return out


def _assigner(pivots: dict[int, np.ndarray], cosine: float):
    theta = math.acos(cosine)
    slack = 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("dim", pa.int32()), ("cell", pa.int32()), ("home", pa.bool_()), ("row", pa.int64())])
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                vectors = batch.column(batch.schema.get_field_index("vec"))
                sizes = np.diff(vectors.offsets.to_numpy())
                values = vectors.flatten().to_numpy(zero_copy_only=False)
                starts = np.concatenate(([0], np.cumsum(sizes)))
                cells = {name: [] for name in schema.names}
                for dim in np.unique(sizes):
                    rows = np.flatnonzero(sizes == dim)
                    p = pivots.get(int(dim))
                    if p is None or len(p) == 1:
                        own = np.zeros(len(rows), dtype=np.int64)
                        outer = np.zeros((len(rows), 1), dtype=bool)
                    else:
                        x = unit(values[starts[rows][:, None] + np.arange(dim)])
                        s = x @ p.T
                        own = s.argmax(axis=1)
                        best = s[np.arange(len(rows)), own]
                        apart = np.sqrt(((p[:, None, :] - p[None, :, :]) ** 2).sum(axis=2))
                        gap = best[:, None] - s
                        angle = np.arccos(np.clip(s, -1, 1))
                        near = np.arccos(np.clip(best, -1, 1))
                        outer = angle <= near[:, None] + 2 * theta + slack
                        outer &= gap <= math.sin(theta) * apart[own] + slack
                        outer &= np.arange(len(p)) > own[:, None]
                    r, c = np.nonzero(outer)
                    for name, v in (("dim", np.full(len(rows) + len(r), dim)), ("cell", np.concatenate((own, c))),
                                    ("home", np.repeat([True, False], [len(rows), len(r)])),
                                    ("row", np.concatenate((rows, rows[r])))):
                        cells[name].append(v)
                flat = {k: np.concatenate(v) if v else np.zeros(0) for k, v in cells.items()}
                row = pa.array(flat["row"].astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(flat["dim"].astype(np.int32)), pa.array(flat["cell"].astype(np.int32)),
                     pa.array(flat["home"].astype(bool)), *[batch.column(i).take(row) for i in range(batch.num_columns)]],
                    names=["dim", "cell", "home", *batch.schema.names])
    return run


def _stars(links: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """The smallest id that each row (a) and column (b) reaches through the links."""
    root_a, root_b = ids_a.copy(), ids_b.copy()
    seen = np.zeros(len(ids_a), dtype=bool)
    for i in np.flatnonzero(links.any(axis=1)):
        if seen[i]:
            continue
        in_a, in_b = np.zeros(len(ids_a), dtype=bool), np.zeros(len(ids_b), dtype=bool)
        new_a = in_a.copy()
        new_a[i] = True
        while new_a.any():
            in_a |= new_a
            new_b = links[new_a].any(axis=0) & ~in_b
            in_b |= new_b
            new_a = (new_b if same else links[:, new_b].any(axis=1)) & ~in_a
        root = min(ids_a[in_a].min(), ids_b[in_b].min())
        root_a[in_a], root_b[in_b] = root, root
        seen |= in_a
    return root_a, (root_a if same else root_b)


def _joiner(cosine: float):
    def run(tile: pd.DataFrame) -> pd.DataFrame:
        left = tile["side"].to_numpy() == 0
        same = bool(tile["same"].iloc[0])
        a, b = tile[left], (tile[left] if same else tile[~left])
        empty = pd.DataFrame({"h1": [], "h2": [], "n": [], "u": [], "v": []}, dtype="int64")
        if not len(a) or not len(b):
            return empty
        x = unit(a["vec"])
        y = x if same else unit(b["vec"])
        weight_a, weight_b = a["c"].to_numpy(np.float64), b["c"].to_numpy(np.float64)
        links = np.empty((len(a), len(b)), dtype=bool)
        for lo in range(0, len(a), 512):
            np.greater_equal(x[lo:lo + 512] @ y.T, cosine, out=links[lo:lo + 512])
        if same:
            np.fill_diagonal(links, False)
        n_a = np.zeros(len(a))
        n_b = np.zeros(len(b))
        for lo in range(0, len(a), 512):
            part = links[lo:lo + 512]
            if part.any():
                n_a[lo:lo + 512] = part @ weight_b
                if not same:
                    n_b += weight_a[lo:lo + 512] @ part
        if not n_a.any():
            return empty
        ids_a, ids_b = a["rep"].to_numpy(), b["rep"].to_numpy()
        root_a, root_b = _stars(links, ids_a, ids_b, same)
        out = [pd.DataFrame({"h1": a["h1"], "h2": a["h2"], "n": n_a.astype("int64"), "u": ids_a, "v": root_a})[n_a > 0]]
        if not same:
            out.append(pd.DataFrame({"h1": b["h1"], "h2": b["h2"], "n": n_b.astype("int64"), "u": ids_b, "v": root_b})[n_b > 0])
        return pd.concat(out)
    return run


def near_vectors(vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id",
                 vec_col: str = "embedding") -> DataFrame:
    """Per row: id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    path = workdir(spark, "vectors")
    v = F.col("vec")
    usable = F.col("id").isNotNull() & F.coalesce(
        v.isNotNull() & (F.size(v) > 0) & F.exists(v, lambda e: e != 0)
        & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf"))), F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    rows = rows.withColumn("usable", usable).withColumn("h1", F.xxhash64("vec")).withColumn(
        "h2", F.xxhash64(F.lit("vector"), "vec"))
    valid = rows.where("usable")
    classes = stage(valid.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("c")), f"{path}/classes")
    points = stage(valid.select(F.col("id").alias("rep"), "h1", "h2", "vec").join(classes, ["h1", "h2", "rep"])
                   .dropDuplicates(["h1", "h2", "rep"]), f"{path}/points")

    sizes = {r["dim"]: r["n"] for r in points.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n"))
             .orderBy(F.desc("n"), "dim").limit(64).collect()}      # other sizes have one cell each
    sample = [r["vec"] for r in points.orderBy(F.xxhash64("rep"), "h1").limit(PIVOT_SAMPLE).select("vec").collect()]
    pivots = choose_pivots(sample, {d: min(MAX_PIVOTS, -(-n // BLOCK)) for d, n in sizes.items()}, cosine)

    point = "h1 long, h2 long, rep long, c long"
    kind = points.schema["vec"].dataType.simpleString()
    placed = stage(points.select("h1", "h2", "rep", "c", "vec").mapInArrow(
        _assigner(pivots, cosine), f"dim int, cell int, home boolean, {point}, vec {kind}"), f"{path}/cells")
    # blocks of a cell: home points, and the replicas of its boundary
    blocks = placed.groupBy("dim", "cell").agg(
        F.ceil(F.count_if("home") / BLOCK).cast("int").alias("nh"),
        F.ceil(F.count_if(~F.col("home")) / BLOCK).cast("int").alias("no"))
    dealt = placed.join(F.broadcast(blocks) if len(sizes) < 64 else blocks, ["dim", "cell"]).withColumn(
        "b", F.pmod(F.xxhash64("rep", "h1"), F.when(F.col("home"), F.col("nh")).otherwise(F.col("no"))).cast("int"))
    tile = lambda i, j, side, same: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"),
                                             F.lit(side).alias("side"), same.alias("same"))
    b = F.col("b")
    home_tiles = F.concat(
        F.transform(F.sequence(F.lit(0), F.col("nh") - 1), lambda o: F.when(
            b <= o, tile(b, o, 0, b == o)).otherwise(tile(o, b, 1, F.lit(False)))),
        F.when(F.col("no") > 0, F.transform(F.sequence(F.lit(0), F.col("no") - 1), lambda o: tile(
            b, -1 - o, 0, F.lit(False)))).otherwise(F.array()))
    outer_tiles = F.when(F.col("nh") > 0, F.transform(F.sequence(F.lit(0), F.col("nh") - 1), lambda o: tile(
        o, -1 - b, 1, F.lit(False)))).otherwise(F.array())
    tiles = dealt.withColumn("t", F.explode(F.when(F.col("home"), home_tiles).otherwise(outer_tiles))).select(
        "dim", "cell", "t.*", "h1", "h2", "rep", "c", "vec")
    found = stage(tiles.groupBy("dim", "cell", "i", "j").applyInPandas(
        _joiner(cosine), "h1 long, h2 long, n long, u long, v long"), f"{path}/links")

    n_links = found.groupBy("h1", "h2").agg(F.sum("n").alias("n"))
    # rows that share an id but not a vector tie their classes together
    of_class = valid.select("id", "h1", "h2").join(classes, ["h1", "h2"]).select("id", "rep")
    tied = of_class.groupBy("id").agg(F.min("rep").alias("u"), F.max("rep").alias("m")).where("u <> m").select("id", "u")
    ties = of_class.join(tied, "id").select("u", F.col("rep").alias("v"))
    labels = components(found.select("u", "v").unionByName(ties))
    known = stage(classes.join(n_links, ["h1", "h2"], "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
                  .select("h1", "h2", F.lit(True).alias("usable"), (F.coalesce("n", F.lit(0)) + F.col("c") - 1).alias("n_links"),
                          F.coalesce("component", "rep").alias("component")), f"{path}/known")
    joined = rows.select("id", "h1", "h2", "usable").join(known, ["h1", "h2", "usable"], "left")
    return joined.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component", "id"), F.lit(True)).alias("kept"))
