"""Merkle manifest of a dataset, with inclusion proofs by coordinate lookup, in DataFrame functions only.

Rows are leaves; of each group they ascend by id, and while a group has several nodes, every ``FANOUT`` consecutive ones become the hash of
their concatenation. The groups' roots are ordered by group and hashed likewise to the root. The node table holds a row for each run of
siblings: its coordinate (group, level, run), the digests in order and their parent's.

Proofs: which coordinates a leaf needs follows from its index and its group's size alone. Leaves whose coordinates are the same from the second
level on (a tile of ``FANOUT`` squared) ask together: the tile's coordinates are exploded and joined with the node table, and come back in
order; each leaf takes the others of its own runs, whose concatenation is its proof, and folds them with its digest to a root. Thus a
leaf's own row is shuffled thrice (by order, for its parent, to its tile), whatever the depth, and a proof isn't shuffled at all.

Indexes come from a sort by ranges and the number of rows of each group in the ranges before: no group meets in one task. Runs near the
root are asked for by all tiles: such hot coordinates are broadcast (``common.join_unique``).

Defined results: a null in any column is hashed as ``-``, which no value is, since values have their length before them; rows without a group (null lang)
are a group of their own, the first; rows without an id come first in their group; rows that repeat are leaves each (of equal ids the one with the lesser digest
first), and each has its own index and proof; a group of one leaf has that leaf as its root and adds no siblings; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, join_unique, materialize

#: Consecutive nodes that make a parent.
FANOUT = 8
#: The lower bits of monotonically_increasing_id count the rows of a partition.
ROW_BITS = 33
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    """Lowercase hexadecimal SHA-256 of the concatenation."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def encoded(value: Column) -> Column:
    """The number of UTF-8 bytes, a colon and the value; a null is a hyphen."""
    s = value.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaves(df: DataFrame, columns: tuple[str, ...], id_col: str, group_col: str, changed: dict[str, Column] | None = None) -> DataFrame:
    """id, value and grp of each row and its digest; entry, the digest with some columns changed (null where it is the same)."""
    own = [encoded(F.col(c)) for c in columns]
    leaf = digest(*own)
    other = digest(*[encoded(changed[c]) if c in changed else e for c, e in zip(columns, own, strict=True)]) if changed else F.lit(None).cast("string")
    value = F.col(group_col).cast("string")
    # a text that is never null and orders the groups: null first, then by bytes
    grp = F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), value))
    rows = df.select(F.col(id_col).alias("id"), grp.alias("grp"), leaf.alias("leaf"), other.alias("entry"))
    return rows.withColumn("entry", F.when(F.col("entry") != F.col("leaf"), F.col("entry")))


def indexed(rows: DataFrame, order: tuple[str, ...]) -> tuple[DataFrame, int, int]:
    """rows with idx, their place in their grp by order, and size, the rows of their grp; how many rows there are, and in the largest grp."""
    placed = rows.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order).withColumn("at", F.monotonically_increasing_id())
    placed = materialize(placed, "placed")
    part = F.shiftright("at", ROW_BITS)
    parts = placed.groupBy("grp", part.alias("part")).agg(F.count("*").alias("rows"), F.min("at").alias("first"))
    own = Window.partitionBy("grp")
    before = F.sum("rows").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # one row for each group in each range: as many as ranges, and groups
    parts = parts.select("grp", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), "rows", F.sum("rows").over(own).alias("size"))
    parts = materialize(parts, "parts")
    total, most = parts.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.max("size"), F.lit(0))).first()
    found = placed.withColumn("part", part).join(parts.drop("rows"), ["grp", "part"]).withColumn("idx", F.col("at") + F.col("shift"))
    found = materialize(found.drop("at", "part", "shift"), "indexed")
    discard(placed, parts)
    return found, total, most


def runs_of(nodes: DataFrame) -> DataFrame:
    """nodes: grp, size, idx, node. grp, size, run, digests in order and parent."""
    one = F.array_sort(F.collect_list(F.struct("idx", "node")))
    runs = nodes.groupBy("grp", "size", F.floor(F.col("idx") / FANOUT).alias("run")).agg(one.alias("nodes"))
    digests = F.transform("nodes", lambda x: x["node"])
    return runs.select("grp", "size", "run", digests.alias("digests"), digest(F.array_join(digests, "")).alias("parent"))


def node_table(rows: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The runs of all levels (grp, size, level, run, digests), and grp, size and root of each group. rows: grp, size, idx, leaf; most: the largest size."""
    nodes = rows.select("grp", "size", "idx", F.col("leaf").alias("node"))
    roots = [nodes.where("size = 1").select("grp", "size", F.col("node").alias("root"))]
    tables, level, span = [], 0, 1
    while most > span:
        made = materialize(runs_of(nodes.where(F.col("size") > span)), "runs")
        span *= FANOUT
        tables.append(made.select("grp", "size", F.lit(level).alias("level"), "run", "digests"))
        # a group ends where it has one parent; larger ones go on
        roots.append(made.where(F.col("size") <= span).select("grp", "size", F.col("parent").alias("root")))
        nodes, level = made.select("grp", "size", F.col("run").alias("idx"), F.col("parent").alias("node")), level + 1
    table = rows.sparkSession.createDataFrame([], "grp string, size bigint, level int, run bigint, digests array<string>")
    for t in tables:
        table = table.unionByName(t)
    ends = roots[0]
    for r in roots[1:]:
        ends = ends.unionByName(r)
    return table, materialize(ends, "roots")


def span_of(level: Column) -> Column:
    """Leaves beneath a node of a level."""
    return F.pow(F.lit(float(FANOUT)), level)


def levels(size: Column) -> Column:
    """How many times nodes are hashed by runs until one is left."""
    return F.size(F.filter(F.sequence(F.lit(0), F.lit(62 // 3)), lambda k: span_of(k) < size))


#: Leaves of a tile.
TILE = FANOUT * FANOUT


def tiles_of(table: DataFrame) -> DataFrame:
    """grp, size and tile of the groups of several leaves: each tile has a first run."""
    first = table.where((F.col("level") == 0) & (F.col("run") % FANOUT == 0))
    return first.select("grp", "size", F.floor(F.col("run") / FANOUT).alias("tile"))


def tile_paths(table: DataFrame, total: int) -> DataFrame:
    """grp, tile and path: the runs (level, run, digests) that the tile's leaves need, in order; none of groups of one leaf. total: a bound on the leaves."""
    size, tile = F.col("size"), F.col("tile")
    coordinate = lambda level, run: F.struct(level.cast("int").alias("level"), run.cast("bigint").alias("run"))
    # at level 0 a tile has up to FANOUT runs, at each further level one
    lowest = F.sequence(tile * FANOUT, F.least(tile * FANOUT + FANOUT - 1, F.floor((size - 1) / FANOUT)))
    lowest = F.transform(lowest, lambda r: coordinate(F.lit(0), r))
    upper = F.filter(F.sequence(F.lit(1), F.greatest(levels(size) - 1, F.lit(1))), lambda k: k < levels(size))
    upper = F.transform(upper, lambda k: coordinate(k, F.floor(tile / span_of(k - 1))))
    name = F.concat_ws(":", "level", "run", "grp").alias("coordinate")
    asked = tiles_of(table).select("grp", "tile", F.explode(F.concat(lowest, upper)).alias("c")).select("grp", "tile", "c.*")
    asked = asked.select("grp", "tile", "level", "run", name)
    # how many tiles ask for a run follows from its level and place
    beneath = span_of(F.col("level") - 1)
    asking = F.when(F.col("level") == 0, F.lit(1)).otherwise(F.least(beneath, F.ceil(size / TILE) - F.col("run") * beneath)).cast("bigint")
    met = join_unique(asked, table.select(name, "digests", asking.alias("asking")), "coordinate", total, "asking")
    return met.groupBy("grp", "tile").agg(F.array_sort(F.collect_list(F.struct("level", "run", "digests"))).alias("path"))


def proofs(rows: DataFrame, table: DataFrame, ends: DataFrame, total: int, above: DataFrame | None = None) -> DataFrame:
    """rows (grp, idx and others) with steps: for each level up to the group's root, the own place in the run and the run's digests.

    above: grp, steps that lead from each group's root on, and others, which rows get.
    """
    lone = ends.where("size = 1").select("grp", F.lit(0).cast("bigint").alias("tile"), F.lit(None).alias("path"))
    tiles = tile_paths(table, total).unionByName(lone)
    if above is not None:
        tiles = materialize(tiles, "tiles")
        counted = above.join(ends.select("grp", F.ceil(F.col("size") / TILE).alias("tiles")), "grp").withColumnRenamed("steps", "further")
        tiles = join_unique(tiles, materialize(counted, "above"), "grp", total, "tiles")
    rows = rows.drop("size").withColumn("tile", F.floor(F.col("idx") / TILE)).join(tiles, ["grp", "tile"])
    own = F.filter("path", lambda p: (p["level"] > 0) | (p["run"] == F.floor(F.col("idx") / FANOUT)))
    place = lambda p: (F.floor(F.col("idx") / span_of(p["level"])) % FANOUT).cast("int")
    steps = F.transform(own, lambda p: F.struct(place(p).alias("place"), p["digests"].alias("digests")))
    steps = F.coalesce(steps, F.array().cast("array<struct<place:int,digests:array<string>>>"))
    rows = rows.withColumn("steps", F.concat(steps, "further") if above is not None else steps)
    return rows.drop("path", "further", "tile")


def siblings(steps: Column) -> Column:
    """The digests of the others of each run, from the leaf to the root, left to right."""
    return F.flatten(F.transform(steps, lambda s: F.filter(s["digests"], lambda d, i: i != s["place"])))


def fold(start: Column, steps: Column) -> Column:
    """The root that start and the siblings lead to."""
    join = lambda got, s: F.array_join(F.transform(s["digests"], lambda d, i: F.when(i == s["place"], got).otherwise(d)), "")
    return F.aggregate(steps, start, lambda got, s: digest(join(got, s)))


def prove(df: DataFrame, columns: tuple[str, ...], id_col: str, group_col: str, changed: dict[str, Column] | None = None) -> DataFrame:
    """One row for each of df: id, leaf, subroot, root, steps (its proof), entry (the changed digest, null if none) and folded, the root that entry,
    or else leaf, leads to with the siblings as they were.

    columns: what is hashed, in order. changed: columns to fold other values of. Rows ascend by id_col within group_col; columns of any other names are ignored.
    """
    first = materialize(leaves(df, columns, id_col, group_col, changed), "leaves")
    rows, total, most = indexed(first, ("id", "leaf"))
    discard(first)
    table, ends = node_table(rows, most)
    # the groups' roots are the leaves of the tree above them
    tops, groups, _ = indexed(ends.select(F.lit("").alias("grp"), F.col("grp").alias("of"), F.col("root").alias("leaf")), ("of",))
    top_table, top_end = node_table(tops, groups)
    led = proofs(tops, top_table, top_end, groups).join(F.broadcast(top_end.select("grp", F.col("root").alias("top"))), "grp")
    led = materialize(led.select(F.col("of").alias("grp"), "steps", F.col("leaf").alias("subroot"), F.col("top").alias("root")), "led")
    found = proofs(rows, table, ends, total, led)
    entry = F.coalesce("entry", "leaf")
    return found.select("id", "leaf", "subroot", "root", "steps", "entry", fold(entry, F.col("steps")).alias("folded"))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)
