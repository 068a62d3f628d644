"""Sharding by a k-d tree over documents' metadata, with DataFrame functions only.

The law is ``bytes``: sizes of shards are near equal. A node of the tree has its number of
shards; it is cut along its widest dimension (the extent of its rows over that of all
rows) at the weighted median, or rather where its halves' numbers of shards want it: the left
part takes the rows whose middle byte lies before that share of the node's bytes.

A cut is found without a sort of the node. Rows are totally ordered by (coordinate, a hash of
id and text, position). The interval that holds the cut is cut into ``BINS`` bins, whose
sizes are sums with map-side partial results; the bin that holds the cut is the next interval,
first of the coordinate, then, where one value holds the cut (a hot source), of the hash, then of the
position (a row that stands very often). When the bin has ``CUT_ROWS`` rows at most, a window over these
finds the row. All nodes of a level are treated at once, and a row a node comes to the driver.

The tree has a row a shard. Rows meet it by a chain of broadcast joins, one a level, wherever
they are read; texts are never shuffled to be placed. Places within a shard are counted by
the positions' file parts, so no shard is numbered in one task.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.llm.runtime import cut_lineage

SHARDS = 24
ROW_BYTES = 8  # of a row besides its text
BINS = 1024
CUT_ROWS = 4096  # rows of an interval that one window sorts
DIMENSIONS = ("source", "lang", "size", "doc_id")
_REACH = 1 << 61  # coordinates stop here, so that differences are longs
_ORDER = ("c", "tie", "row")
_CUT = "node long, dim int, cut_c long, cut_tie long, cut_row long, right long"
_OPEN = "node long, dim int, stage int, lo long, hi long, at_c long, at_tie long, before long, goal decimal(38,0)"


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string").cast("binary"), F.lit(b""))


def _prefix(name: str) -> Column:
    """The first seven bytes of a string as a number; order is kept, longer ones are told apart by the hash."""
    raw = F.rpad(F.hex(F.substring(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary"), 1, 7)), 14, "0")
    return F.conv(raw, 16, 10).cast("long")


def placed_columns() -> list[Column]:
    """A row's coordinates and order, from its own columns."""
    number = F.coalesce(F.col("doc_id").cast("long"), F.lit(0))
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"), F.lit(b":"), _text())
    return [
        (F.octet_length(_text()) + ROW_BYTES).cast("long").alias("size"),
        F.struct(_prefix("source").alias("source"), _prefix("lang").alias("lang"), (F.octet_length(_text()) + ROW_BYTES).cast("long").alias("size"), F.greatest(F.least(number, F.lit(_REACH)), F.lit(-_REACH)).alias("doc_id")).alias("at"),
        F.conv(F.substring(F.md5(name), 1, 12), 16, 10).cast("long").alias("tie"),
        F.monotonically_increasing_id().alias("row"),
    ]


def _along(dim: Column) -> Column:
    """The coordinate of a row's node's dimension."""
    out = F.lit(None).cast("long")
    for d, name in enumerate(DIMENSIONS):
        out = F.when(dim == d, F.col(f"at.{name}")).otherwise(out)
    return out


def _literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of numbers as a part of the plan."""
    names = [c.split()[0] for c in schema.split(", ")]
    text = json.dumps([dict(zip(names, row)) for row in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{schema.replace(' ', ':').replace(',:', ',')}>>")))


@dataclass
class Tree:
    """Cuts of each level: ``(node, dim, cut_c, cut_tie, cut_row, right)``; a node is its first shard."""

    shards: int
    levels: list[list[tuple]] = field(default_factory=list)

    def nodes(self) -> dict[int, int]:
        """Nodes after the last level, with their numbers of shards."""
        firsts = sorted({0} | {cut[-1] for level in self.levels for cut in level})
        return {a: b - a for a, b in zip(firsts, [*firsts[1:], self.shards])}

    def place(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``node``; a broadcast join a level, of a row a node."""
        rows = rows.withColumn("node", F.lit(0).cast("long"))
        for level in self.levels:
            joined = rows.join(F.broadcast(_literal(rows.sparkSession, level, _CUT)), "node", "left").withColumn("c", _along(F.col("dim")))
            left = F.struct(*_ORDER) <= F.struct(F.col("cut_c").alias("c"), F.col("cut_tie").alias("tie"), F.col("cut_row").alias("row"))
            rows = joined.withColumn("node", F.when(F.col("dim").isNull() | left, F.col("node")).otherwise(F.col("right"))).drop("c", "dim", "cut_c", "cut_tie", "cut_row", "right")
        return rows


def _extents(rows: DataFrame) -> dict[int, dict]:
    """Bytes and each dimension's least and greatest coordinate of each node."""
    ends = [f(F.col(f"at.{d}")).alias(f"{f.__name__}_{d}") for d in DIMENSIONS for f in (F.min, F.max)]
    return {r["node"]: r.asDict() for r in rows.groupBy("node").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), *ends).collect()}


def _widest(own: dict, whole: dict) -> int:
    """The dimension of the greatest extent, as a share of all rows'; the first of equal ones."""
    extent = lambda x, d: x[f"max_{d}"] - x[f"min_{d}"]
    return max(range(len(DIMENSIONS)), key=lambda k: (extent(own, DIMENSIONS[k]) / max(extent(whole, DIMENSIONS[k]), 1), -k))


def _inside(rows: DataFrame, intervals: list[tuple]) -> DataFrame:
    """Rows of the nodes' intervals, with the interval's column as ``v``.

    An interval ``(node, dim, stage, lo, hi, c, tie, before, goal)`` is [lo, hi] of the order's column number
    ``stage`` under the values found for those before it; ``before`` are the node's bytes left of
    it, and ``goal`` is twice the bytes that the left side should have.
    """
    joined = rows.join(F.broadcast(_literal(rows.sparkSession, intervals, _OPEN)), "node").withColumn("c", _along(F.col("dim")))
    same = ((F.col("stage") < 1) | (F.col("c") == F.col("at_c"))) & ((F.col("stage") < 2) | (F.col("tie") == F.col("at_tie")))
    value = F.when(F.col("stage") == 0, F.col("c")).when(F.col("stage") == 1, F.col("tie")).otherwise(F.col("row"))
    return joined.where(same).withColumn("v", value).where("v BETWEEN lo AND hi")


def _narrowed(rows: DataFrame, active: list[tuple], bins: int) -> list[dict]:
    """For each interval, the bin that holds its node's cut."""
    inside = _inside(rows, active)
    bin_ = F.expr(f"(v - lo) DIV ((hi - lo) DIV {bins} + 1)")
    sums = inside.groupBy("node", "before", "goal", bin_.alias("bin")).agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    by_bin = W.partitionBy("node").orderBy("bin")  # BINS rows a node at most
    start = F.col("before") + F.coalesce(F.sum("bytes").over(by_bin.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = sums.withColumn("start", start).withColumn("last", F.max("bin").over(W.partitionBy("node")))
    # the cut is in the first bin whose end lies beyond the goal, or in the last one
    beyond = (F.col("start") + F.col("bytes")).cast("decimal(38,0)") * 2 > F.col("goal")
    return [r.asDict() for r in placed.where(beyond | (F.col("bin") == F.col("last"))).groupBy("node").agg(F.min_by(F.struct("start", "n", "lo", "hi"), "bin").alias("x")).select("node", "x.*").collect()]


def _cut_rows(rows: DataFrame, small: list[tuple]) -> dict[int, tuple]:
    """For each node, the last row of the left side among those of its interval; nodes without one are absent."""
    inside = _inside(rows, small)
    run = W.partitionBy("node").orderBy(*_ORDER).rowsBetween(W.unboundedPreceding, -1)  # CUT_ROWS rows a node at most
    first = F.col("before") + F.coalesce(F.sum("size").over(run), F.lit(0))
    left = inside.withColumn("first", first).where(F.col("first").cast("decimal(38,0)") * 2 + F.col("size") <= F.col("goal"))
    found = left.groupBy("node").agg(F.max(F.struct(*_ORDER)).alias("x")).select("node", "x.*")
    return {r["node"]: (r["c"], r["tie"], r["row"]) for r in found.collect()}


def _cuts(rows: DataFrame, wanted: dict[int, int], stats: dict[int, dict], whole: dict, bins: int, cut_rows: int) -> list[tuple]:
    """The cut of each node of more than one shard."""
    split = {node: k for node, k in wanted.items() if k > 1 and node in stats}
    dims = {node: _widest(stats[node], whole) for node in split}
    goals = {node: 2 * stats[node]["bytes"] * (k // 2) // k for node, k in split.items()}
    state = {n: (0, stats[n][f"min_{DIMENSIONS[d]}"], stats[n][f"max_{DIMENSIONS[d]}"], 0, 0, 0) for n, d in dims.items()}
    rows_in = {n: stats[n]["n"] for n in split}
    entry = lambda n: (n, dims[n], *state[n], goals[n])
    full = ((0, (1 << 48) - 1), (0, 1 << 62))  # of hashes and of positions
    while open_ := [n for n in split if rows_in[n] > cut_rows]:
        for got in _narrowed(rows, [entry(n) for n in open_], bins):
            n, (stage, _, _, c, tie, _) = got["node"], state[got["node"]]
            rows_in[n] = got["n"]
            lo, hi = got["lo"], got["hi"]
            if lo == hi and stage < 2 and got["n"] > cut_rows:  # one value holds the cut: on to the next column
                c, tie = (lo, tie) if stage == 0 else (c, lo)
                stage, (lo, hi) = stage + 1, full[stage]
            state[n] = (stage, lo, hi, c, tie, got["start"])
    found = _cut_rows(rows, [entry(n) for n in split]) if split else {}
    least = -(1 << 63)
    out = []
    for n, k in split.items():
        if n in found:
            c, tie, row = found[n]
        else:  # the interval's rows all go right: the cut is before its first value
            stage, lo, _, c, tie, _ = state[n]
            c, tie, row = (lo, least, least) if stage == 0 else (c, lo, least) if stage == 1 else (c, tie, lo - 1)
        out.append((n, dims[n], c, tie, row, n + k // 2))
    return out


def grown_tree(rows: DataFrame, shards: int, bins: int = BINS, cut_rows: int = CUT_ROWS) -> Tree:
    """The tree of ``shards`` leaves over ``(size, at, tie, row)`` rows."""
    tree, whole = Tree(shards), None
    while any(k > 1 for k in tree.nodes().values()):
        placed = tree.place(rows)
        stats = _extents(placed)
        whole = whole or stats.get(0)
        level = _cuts(placed, tree.nodes(), stats, whole, bins, cut_rows)
        # a node without rows is cut too, so that the tree ends
        level += [(n, 0, 0, 0, 0, n + k // 2) for n, k in tree.nodes().items() if k > 1 and n not in stats]
        tree.levels.append(level)
    return tree


def _numbered(placed: DataFrame) -> DataFrame:
    """``slot`` of each row in its shard, in order of position, counted by file part."""
    parts = placed.withColumn("part", F.shiftright("row", 33))
    totals = parts.groupBy("node", "part").agg(F.count("*").alias("n"))
    before = W.partitionBy("node").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    base = totals.select("node", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = W.partitionBy("node", "part").orderBy("row")
    return parts.join(base, ["node", "part"]).withColumn("slot", F.col("base") + F.row_number().over(within) - 1)


def _shard_count(rows: DataFrame, shards: int | None, target_bytes: int | None) -> int:
    if target_bytes is None:
        return shards or SHARDS
    total = rows.agg(F.sum("size")).first()[0] or 0
    return max(1, -(-total // target_bytes))


def kd_shards(docs: DataFrame, shards: int | None = SHARDS, target_bytes: int | None = None, bins: int = BINS, cut_rows: int = CUT_ROWS) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard (null: the law is ``bytes``).

    With ``target_bytes`` the number of shards is what leaves of that size need. Null texts have
    no bytes (their size is ``ROW_BYTES``, their crc32 that of the empty text). Null and empty sources and languages stand
    together, null ids stand at 0. Rows of equal coordinates go by a hash of id and text, and rows
    alike in these by position, so copies, a hot source and repeated rows are divided where a
    cut needs it, and copies of a text with other metadata may be in several shards. A row
    is never divided: a shard misses its share by at most half a row's size a
    level. With fewer rows than shards some shards are empty, and so is an empty table's result.
    """
    rows = cut_lineage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.crc32(_text()).alias("text_crc32"), *placed_columns()))
    tree = grown_tree(rows, _shard_count(rows, shards, target_bytes), bins, cut_rows)
    numbered = _numbered(tree.place(rows))
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("node").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, folder: str, shards: int | None = SHARDS, target_bytes: int | None = None) -> str:
    """``docs`` as Parquet under ``folder``, a subfolder ``shard=<number>`` for each shard.

    A row's shard is worked out where the row is read, from its own columns and the tree, and its
    text goes straight to its file. Where ``docs`` has a column ``shard``, the folders' name
    gets underscores until it is free.
    """
    name = "shard"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    rows = cut_lineage(docs.select(*placed_columns()))
    tree = grown_tree(rows, _shard_count(rows, shards, target_bytes))
    own = docs.select(F.struct("*").alias("_doc"), *placed_columns())
    placed = tree.place(own).select("_doc.*", F.col("node").cast("int").alias(name))
    placed.write.mode("overwrite").partitionBy(name).parquet(folder)
    return folder
