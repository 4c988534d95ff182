"""Stratified assignment with controlled rounding: arms and strata have exactly the sizes they are to have."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from memlode.operators.stats import HashStream


def controlled_rounding(rows: list[int], columns: list[int], stream: HashStream) -> list[list[int]]:
    """An integer table with these row and column sums in which every cell is rows x columns / n rounded up or down.

    All such tables are equally likely.  Cells are decided one after the other, by how many tables each
    choice leaves; that number follows from what the row and the columns still need, so tables are
    counted, not listed.  Cells that are whole stay.  Meant for a few arms by up to a hundred strata: what
    is remembered grows with the needs of the shorter side.
    """
    if len(columns) > len(rows):
        return [list(r) for r in zip(*controlled_rounding(columns, rows, stream))]
    n = sum(rows)
    if n != sum(columns) or n == 0:
        raise ValueError("row and column sums must agree and not be 0")
    base = [[a * b // n for b in columns] for a in rows]
    free = [[a * b % n != 0 for b in columns] for a in rows]
    need_row = [a - sum(r) for a, r in zip(rows, base)]
    need_col = tuple(b - sum(r[j] for r in base) for j, b in enumerate(columns))

    @lru_cache(maxsize=None)
    def tables(i: int, j: int, row: int, cols: tuple[int, ...]) -> int:
        if j == len(columns):
            if row:
                return 0
            return (not any(cols)) if i + 1 == len(rows) else tables(i + 1, 0, need_row[i + 1], cols)
        out = tables(i, j + 1, row, cols)
        if free[i][j] and row and cols[j]:
            out += tables(i, j + 1, row - 1, (*cols[:j], cols[j] - 1, *cols[j + 1 :]))
        return int(out)

    if not tables(0, 0, need_row[0], need_col):
        raise ValueError("no table rounds every cell up or down with these sums")
    out, cols = [r[:] for r in base], need_col
    for i in range(len(rows)):
        row = need_row[i]
        for j in range(len(columns)):
            if not (free[i][j] and row and cols[j]):
                continue
            up = tables(i, j + 1, row - 1, (*cols[:j], cols[j] - 1, *cols[j + 1 :]))
            if stream.below(tables(i, j, row, cols)) < up:
                out[i][j] += 1
                row, cols = row - 1, (*cols[:j], cols[j] - 1, *cols[j + 1 :])
    return out


def assigned(units: DataFrame, shares: dict[str, int], seed: str) -> DataFrame:
    """(unit, stratum, arm) for units (unit, stratum): arms in the proportion of ``shares``, exact in all and
    within one unit in each stratum.

    The sizes of arms are the shares of all units, rounded down, what is left over going to the first arms.
    Within a stratum, units stand in the order of a salted digest and arms take runs of it.  Strata reach
    the driver (one row each), units do not; a stratum is ranked by range, so a large one meets no one task.
    """
    spark = units.sparkSession
    strata = units.groupBy("stratum").count().orderBy("stratum").collect()
    n, total = sum(r["count"] for r in strata), sum(shares.values())
    if not n:
        return units.select("unit", "stratum", F.lit("").alias("arm"))
    sizes = [n * s // total for s in shares.values()]
    for i in range(n - sum(sizes)):
        sizes[i] += 1
    table = controlled_rounding(sizes, [r["count"] for r in strata], HashStream(seed))
    runs, low = [], [0] * len(strata)
    for arm, row in zip(shares, table):
        for j, take in enumerate(row):
            runs.append((strata[j]["stratum"], arm, low[j], low[j] + take))
            low[j] += take
    kind = {f.name: f.dataType.simpleString() for f in units.schema}["stratum"]
    cuts = spark.createDataFrame(runs, f"s_ {kind}, arm string, low long, high long")
    ordered = units.select("unit", "stratum", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("unit").cast("string")), 256).alias("key_"))
    turn = _place(ordered)
    return turn.join(F.broadcast(cuts), F.col("stratum").eqNullSafe(F.col("s_")) & (F.col("place") >= F.col("low")) & (F.col("place") < F.col("high"))).select("unit", "stratum", "arm")


def _place(rows: DataFrame) -> DataFrame:
    """Each row's place (from 0) in its stratum by key_, then unit: the first digits of the digest deal a stratum into
    256 parts, a part's rows are ranked alone and start after the parts before it."""
    part = F.conv(F.substring("key_", 1, 2), 16, 10).cast("int")
    rows = rows.withColumn("part_", part)
    before = W.partitionBy("sb_").orderBy("pb_").rowsBetween(W.unboundedPreceding, -1)
    starts = rows.groupBy(F.col("stratum").alias("sb_"), F.col("part_").alias("pb_")).agg(F.count("*").alias("n_")).withColumn("start", F.coalesce(F.sum("n_").over(before), F.lit(0)))
    own = rows.withColumn("r_", F.row_number().over(W.partitionBy("stratum", "part_").orderBy("key_", "unit")) - 1)
    return own.join(starts, F.col("stratum").eqNullSafe(F.col("sb_")) & (F.col("part_") == F.col("pb_"))).select("unit", "stratum", (F.col("start") + F.col("r_")).alias("place"))
