"""Dominance counting: how many rows lie strictly before another one in one coordinate and strictly above it in the other.

Rows are collapsed to distinct cells (slot, level). A cell's coordinates, from the smallest on, are read as digits to the
base TILE. Of two cells that differ in both, let i and j be the highest digits in which their slots and levels differ:
then both lie in one tile of the resolution (i, j), a square of TILE x TILE blocks, and in that tile their blocks differ
both ways. So what dominates a cell is the sum over all (i, j) of strict cumulative sums within one tile: at (0, 0) those
of its own tile; at (0, j) a carry column, of tiles with the same slots further up; at (i, 0) a carry row, of earlier
tiles at the same levels; else whole tiles before and above. Each tile is a bounded group at every size of the input,
and no tile waits for another.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text as T

BITS = 4
#: Blocks on a side of a tile: a group has the square of it at most, 256.
TILE = 1 << BITS
#: Tiles that are laid out at a time.
STEP = 512
#: Levels of a greater magnitude are none: doubles can't tell such numbers apart.
MOST_LEVEL = 1 << 53
SECONDS, CENTS = 86_400, 1_000


def _sums(weights: int):
    """A task's tiles (i, j, tile_x, tile_y, blocks) to rows (i, j, x, y, sums of the blocks before and above)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for first in range(0, batch.num_rows, STEP):
                part = batch.slice(first, STEP)
                lists = part.column(4)
                sizes = np.diff(lists.offsets.to_numpy())
                flat = lists.flatten()
                tile = np.repeat(np.arange(len(sizes)), sizes)
                dx, dy = (flat.field(k).to_numpy().astype(np.int64) for k in (0, 1))
                out = []
                for k in range(weights):
                    grid = np.zeros((len(sizes), TILE, TILE), np.int64)
                    grid[tile, dx, dy] = flat.field(2 + k).to_numpy()
                    before = np.cumsum(grid, axis=1) - grid
                    above = np.cumsum(before[:, :, ::-1], axis=2)[:, :, ::-1] - before
                    out.append(pa.array(above[tile, dx, dy]))
                i, j, x, y = (part.column(k).to_numpy()[tile] for k in range(4))
                yield pa.record_batch([pa.array(i), pa.array(j), pa.array(x * TILE + dx), pa.array(y * TILE + dy), *out], names=["i", "j", "x", "y", *(f"w{k}" for k in range(weights))])

    return T.trimmed(run)


def _digits(low: int, high: int) -> int:
    """How many digits of the base TILE hold all of 0 to high - low; one at least."""
    return max(1, -(-(high - low).bit_length() // BITS))


def dominating(cells: DataFrame, x: str, y: str, weights: list[str]) -> DataFrame:
    """`cells` (x, y, weights; distinct in x and y, all longs) with each weight replaced by its sum over the cells of smaller x and larger y.

    Cells with a null coordinate are left out; null weights are 0; an empty table gives an empty one. `cells` is read
    three times: hand in a written table. The range of the coordinates decides how many resolutions there are, the
    product of their numbers of digits; a single far outlier adds a few.
    """
    cells = cells.select(F.col(x).cast("long").alias("x"), F.col(y).cast("long").alias("y"), *(F.coalesce(F.col(w).cast("long"), F.lit(0)).alias(f"w{k}") for k, w in enumerate(weights))).where("x is not null and y is not null")
    names = [f"w{k}" for k in range(len(weights))]
    ends = cells.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    named = [F.col(n).alias(w) for n, w in zip(names, weights)]
    if ends["x0"] is None:
        return cells.select(F.col("x").alias(x), F.col("y").alias(y), *named)
    pairs = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(_digits(ends["x0"], ends["x1"])) for j in range(_digits(ends["y0"], ends["y1"]))]
    seen = cells.withColumn("at", F.explode(F.array(*pairs))).select(F.col("x").alias("cx"), F.col("y").alias("cy"), *names, "at.i", "at.j")
    seen = seen.withColumn("x", F.expr(f"shiftright(cx - {ends['x0']}L, {BITS} * i)")).withColumn("y", F.expr(f"shiftright(cy - {ends['y0']}L, {BITS} * j)"))
    blocks = seen.groupBy("i", "j", "x", "y").agg(*(F.sum(n).alias(n) for n in names))
    tiles = blocks.groupBy("i", "j", F.shiftright("x", BITS).alias("tx"), F.shiftright("y", BITS).alias("ty")).agg(F.collect_list(F.struct((F.col("x") % TILE).cast("int").alias("dx"), (F.col("y") % TILE).cast("int").alias("dy"), *names)).alias("blocks"))
    sums = tiles.mapInArrow(_sums(len(names)), "i int, j int, x long, y long, " + ", ".join(f"{n} long" for n in names))
    found = seen.drop(*names).join(sums.hint("merge"), ["i", "j", "x", "y"])
    return found.groupBy(F.col("cx").alias(x), F.col("cy").alias(y)).agg(*(F.sum(n).alias(w) for n, w in zip(names, weights)))


def slot(sold_at: Column, kind: str) -> Column:
    """Days since 1970 of a time without a zone, or of one with a zone, taken as UTC; null for null."""
    if kind == "timestamp":
        return F.floor(F.unix_seconds(sold_at) / SECONDS).cast("long")
    return F.unix_date(sold_at.cast("date")).cast("long")


def level(total: Column) -> Column:
    """Tens of the currency: floor(floor(100 * total + 0.5) / 1000), in double arithmetic; null for null, NaN, infinite and over 2**53."""
    total = total.cast("double")
    usable = ~F.isnan(total) & (F.abs(total) < float(MOST_LEVEL // 100))
    return F.floor(F.floor(F.when(usable, total) * F.lit(100.0) + F.lit(0.5)).cast("double") / F.lit(float(CENTS))).cast("long")


def stands_for(ids: Column) -> Column:
    """How many equal rows a sale stands for: 1 to 3, by the crc32 of its decimal id; 1 for a null id."""
    return 1 + F.coalesce(F.crc32(ids.cast("string").cast("binary")) % 3, F.lit(0))


def sales_above(sales: DataFrame) -> DataFrame:
    """For each row of `sales` (sale_id, sold_at, total): its slot and level, and how many sales, and rows these stand for, are above it.

    A sale is above another if its slot is smaller and its level strictly larger. Sales without a slot or level count for
    nothing and have null counts; a null sale_id is a sale as others; repeated rows each count and each get a row; equal
    slots or levels don't dominate; an empty table gives an empty one; columns beside the three are ignored, whatever
    their names. A cell that many sales share is one row until the counts are joined back, where Spark splits it again
    (a skew join); sales without a cell are dealt by their ids.
    """
    kind = dict(sales.dtypes)["sold_at"]
    rows = sales.select(F.col("sale_id").cast("long").alias("sale_id"), slot(F.col("sold_at"), kind).alias("slot"), level(F.col("total")).alias("level"))
    cells = rows.where("slot is not null and level is not null").groupBy("slot", "level").agg(F.count("*").alias("n_sales"), F.sum(stands_for(F.col("sale_id"))).alias("n_rows"))
    counts = dominating(T.checkpoint(cells), "slot", "level", ["n_sales", "n_rows"])
    none = F.expr("slot is null or level is null")
    nowhere = F.lit(-(1 << 62)) + F.pmod(F.xxhash64("sale_id"), F.lit(1 << 40))  # a slot that no date has
    left = rows.withColumn("at_slot", F.when(none, nowhere).otherwise(F.col("slot"))).withColumn("at_level", F.coalesce("level", F.lit(0)))
    right = counts.select(F.col("slot").alias("at_slot"), F.col("level").alias("at_level"), "n_sales", "n_rows").hint("merge")
    return left.join(right, ["at_slot", "at_level"], "left").select("sale_id", "slot", "level", "n_sales", "n_rows")


def op12_dominance(spark, sf_dir: str) -> DataFrame:
    return sales_above(T.table(spark, sf_dir, "sales"))


SQL = """
with crc as materialized (
  select list_transform(range(256), lambda n: list_reduce(range(8), lambda a, k: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end, n)) as t),
s as materialized (
  select sale_id, cast(date_diff('day', date '1970-01-01', cast(sold_at as date)) as bigint) as slot,
    cast(floor(floor(100 * total + 0.5) / 1000) as bigint) as level,
    1 + xor(list_reduce(string_split(sale_id::varchar, ''), lambda a, c: xor(a >> 8, t[(xor(a, ascii(c)) & 255) + 1]), 4294967295::bigint), 4294967295) % 3 as r
  from sales, crc),
cells as materialized (
  select slot, level, count(*) as n, sum(r) as r from s where slot is not null and level is not null group by all),
up as (
  select a.slot, a.level, sum(b.n) as n, sum(b.r) as r
  from cells a join cells b on b.slot < a.slot and b.level > a.level group by all)
select sale_id, s.slot, s.level,
  cast(case when s.slot is not null and s.level is not null then coalesce(up.n, 0) end as bigint) as n_sales,
  cast(case when s.slot is not null and s.level is not null then coalesce(up.r, 0) end as bigint) as n_rows
from s left join up on up.slot = s.slot and up.level = s.level
"""
