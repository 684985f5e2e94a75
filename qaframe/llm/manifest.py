"""Merkle manifest of a dataset, built with lag and lead windows (operator 13).

Every row is a leaf.  The leaves of a group ascend by id; while several nodes
remain, every three consecutive ones (the last run may hold fewer, even one) become
their digest; what remains is the group's subroot.  The subroots, in the order of
their groups, give the root in the same way.  A row gets its proof: level by level
the other nodes of its run, those on the left and those on the right.

Nodes have dense positions, so the node `k` places on lies `k` rows on.  Level
by level, lag and lead columns of fixed offsets (3 ** level rows, and twice as many),
masked by a node's slot in its run and by the run's length, give its siblings;
rows of first children hash the parents.  A window holds a block of
`arity ** LEVELS` leaves of one group and climbs `LEVELS` levels without another
exchange or sort.  The tops of the blocks, one row each, are the leaves of the next
round, until every group has one top; the proofs then come down by joins on
(group, block).  No window or join key ever holds more than a block, however
many rows a group has.

Positions come from range partitions of the narrow rows and the partitions'
totals, not from a window over a group.  Texts are read once and never move.

Defined results: a null value counts as `-` in a leaf; null ids come first, rows of
equal id are ordered by their leaf, and repeated rows are leaves of their own.  A null
group is a group, and comes first.  An empty table gives an empty manifest.  A single
leaf is its group's subroot, a single subroot the root, with an empty proof.  Texts
are hashed whole, however long.  Columns besides those named are not read; names
may clash with any used inside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qaframe.llm.common import shuffle_width, stage, workdir

ARITY = 3
LEVELS = 7                    # levels of a round: blocks of 2,187 leaves
BROADCAST_BLOCKS = 20_000     # rows of about 2 KB: up to 40 MB


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts, one after another."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf_digest(columns: list[Column]) -> Column:
    """Digest of a row: per column `-` if null, else its UTF-8 byte count, `:` and the value."""
    def value(c: Column) -> Column:
        s = c.cast("string")
        return F.when(s.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))
    return digest(*[value(c) for c in columns])


def _positions(rows: DataFrame, order: list[str], path: str) -> DataFrame:
    """Adds `pos`, the place of each row in its group `g` by `order`, and `cnt`, the group's rows."""
    width = shuffle_width(rows.sparkSession)
    keys = ["g", *order]
    # rows equal in all of `order` are dealt by `tie`, so that copies do not meet in one range
    tied = stage(rows.withColumn("tie", F.monotonically_increasing_id()), f"{path}/rows")
    ranged = stage(tied.repartitionByRange(width, *keys, "tie").withColumn("part", F.spark_partition_id()), f"{path}/ranges")
    totals = ranged.groupBy("g", "part").agg(F.count("*").alias("n"))
    of_group = Window.partitionBy("g")
    offsets = totals.select(
        "g", "part", F.sum("n").over(of_group).alias("cnt"),
        (F.sum("n").over(of_group.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    offsets = stage(offsets, f"{path}/offsets")
    inside = Window.partitionBy("g", "part").orderBy(*order, "tie")
    ranked = ranged.withColumn("rn", F.row_number().over(inside))
    if offsets.count() <= BROADCAST_BLOCKS:
        offsets = F.broadcast(offsets)
    return (ranked.join(offsets, ["g", "part"]).withColumn("pos", F.col("before") + F.col("rn") - 1)
            .drop("part", "before", "rn", "tie"))


def _climb(nodes: DataFrame) -> DataFrame:
    """Adds to nodes (g, pos, cnt, v): `block`, `path` (their siblings on LEVELS levels)
    and `top` (of the block, on its first row)."""
    of_block = Window.partitionBy("g", "block").orderBy("pos")
    df = nodes.withColumn("block", F.floor(F.col("pos") / ARITY ** LEVELS)).withColumn("v0", F.col("v"))
    steps = []
    for k in range(LEVELS):
        off = ARITY ** k
        v = F.col(f"v{k}")
        df = df.select("*", *[F.lag(v, i * off).over(of_block).alias(f"lag{i}") for i in (1, 2)],
                       *[F.lead(v, i * off).over(of_block).alias(f"lead{i}") for i in (1, 2)])
        here = F.floor(F.col("pos") / off)
        slot = F.pmod(here, F.lit(ARITY))
        held = F.ceil(F.col("cnt") / off)                        # nodes of the group on this level
        run = F.least(F.lit(ARITY), held - here + slot)          # nodes of this run
        left = F.when(slot == 1, F.col("lag1")).when(slot == 2, F.concat("lag2", "lag1")).otherwise("")
        right = (F.when((slot == 0) & (run == 3), F.concat("lead1", "lead2"))
                 .when(((slot == 0) & (run == 2)) | ((slot == 1) & (run == 3)), F.col("lead1")).otherwise(""))
        node = F.pmod(F.col("pos"), F.lit(off)) == 0
        several = held > 1
        df = df.withColumn(f"s{k}", F.when(node & several, F.struct(left.alias("left"), right.alias("right"))))
        parent = F.when(several, digest(v, F.col(f"s{k}.right"))).otherwise(v)
        df = df.withColumn(f"v{k + 1}", F.when(node & (slot == 0), parent)).drop(f"v{k}", "lag1", "lag2", "lead1", "lead2")
        # the siblings of the node above a row stand at or before the row
        steps.append(F.last(f"s{k}", ignorenulls=True).over(of_block.rowsBetween(Window.unboundedPreceding, 0)))
    path = F.filter(F.array(*steps), lambda s: s.isNotNull())
    return df.withColumn("path", path).withColumnRenamed(f"v{LEVELS}", "top").drop(*[f"s{k}" for k in range(LEVELS)])


def _tree(leaves: DataFrame, path: str) -> tuple[list[DataFrame], DataFrame]:
    """All rounds over leaves (g, pos, cnt, v): the nodes of each with their paths, and (g, root)."""
    rounds = []
    nodes = leaves
    while True:
        done = stage(_climb(nodes), f"{path}/round-{len(rounds)}")
        rounds.append(done)
        tops = done.where(F.pmod("pos", F.lit(ARITY ** LEVELS)) == 0).select(
            "g", F.col("block").alias("pos"), F.ceil(F.col("cnt") / ARITY ** LEVELS).alias("cnt"), F.col("top").alias("v"))
        if (tops.agg(F.max("cnt")).first()[0] or 1) == 1:
            return rounds, tops.select("g", F.col("v").alias("root"))
        nodes = tops


def _come_down(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """The leaves with their whole paths; `above` holds (g, up, ...) for every group."""
    rest = [c for c in above.columns if c not in ("g", "up")]
    upper = above.withColumn("block", F.lit(0).cast("long"))
    for nodes in reversed(rounds):
        joined = nodes.join(F.broadcast(upper) if upper.count() <= BROADCAST_BLOCKS else upper, ["g", "block"])
        joined = joined.withColumn("path", F.concat("path", "up")).drop("up", "top", "block")
        upper = joined.select("g", F.col("pos").alias("block"), F.col("path").alias("up"), *rest)
    return joined


def merkle_manifest(docs: DataFrame, columns: list[str], group_col: str = "source", id_col: str = "doc_id",
                    carry: dict[str, Column] | None = None) -> DataFrame:
    """Per row: id, group, leaf, subroot, root, path and the carried columns.

    `path` is an array of (left, right) from the leaf's level to the root's: the
    concatenated digests of the run's other nodes on either side.  `carry` adds
    columns computed from the row when it is read."""
    spark = docs.sparkSession
    path = workdir(spark, "manifest")
    carry = carry or {}
    extra = [f"x{i}" for i in range(len(carry))]
    group = F.col(group_col).cast("string")
    rows = docs.select(
        F.when(group.isNull(), "0").otherwise(F.concat(F.lit("1"), group)).alias("g"), F.col(id_col).alias("id"),
        leaf_digest([F.col(c) for c in columns]).alias("v"), *[c.alias(x) for c, x in zip(carry.values(), extra)])
    rounds, subroots = _tree(_positions(rows, ["id", "v"], f"{path}/leaves"), f"{path}/groups")
    groups = subroots.select(F.lit("").alias("g"), F.col("g").alias("name"), F.col("root").alias("v"))
    upper, root = _tree(_positions(groups, ["name"], f"{path}/subroots"), f"{path}/top")
    none = F.array().cast("array<struct<left:string,right:string>>")
    above = _come_down(upper, root.withColumn("up", none))
    above = above.select(F.col("name").alias("g"), F.col("path").alias("up"), F.col("v").alias("subroot"), "root")
    out = _come_down(rounds, stage(above, f"{path}/above"))
    return out.select(
        F.col("id").alias(id_col), F.when(F.col("g") != "0", F.expr("substring(g, 2)")).alias(group_col),
        F.col("v").alias("leaf"), "subroot", "root", "path", *[F.col(x).alias(n) for x, n in zip(extra, carry)])


def proof_digest(path: Column) -> Column:
    """Digest of all siblings, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))


def fold(path: Column, leaf: Column) -> Column:
    """The root that a leaf and the siblings of a path give."""
    return F.aggregate(path, leaf, lambda above, s: digest(s["left"], above, s["right"]))
