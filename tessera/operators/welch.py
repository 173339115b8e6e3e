"""Inside-versus-outside Welch tests over a grid of groups and measures. One operator serves every view.

Nothing is computed per pair of row and group: sums inside each group come from one aggregation, sums over all rows from
another, and outside is all minus inside. Absent cells are zeros, so counts come from the membership table and never
from the cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions.stats import cohens_d, mean, variance, welch_z


def welch_grid(values: DataFrame, members: DataFrame, n_all: DataFrame, group: str = "k", measure: str = "m", split: bool = False, measures: DataFrame | None = None) -> DataFrame:
    """(group, measure, n_in, n_out, u_in, u_out, delta, z_score, cohens_d and, with split, delta_a, delta_b, ...).

    values(row_idx, measure, u): cells, absent = 0, only rows of the pool. members(row_idx, group): a row may be in
    several groups. n_all: one row (n_pool, n_even, n_odd), rows of the pool and of its halves by parity of row_idx.
    Groups with fewer than two rows inside or outside are left out. The grid has every group with every measure: those of
    measures(measure), or without it those with a cell.
    """
    even = (F.col("row_idx") % 2 == 0).cast("int")
    u, ue = F.col("u"), F.col("u") * even
    sums = [F.sum(u).alias("s"), F.sum(u * u).alias("q"), F.sum(ue).alias("se")]
    inside = values.join(members, "row_idx").groupBy(group, measure).agg(*sums)
    total = values.groupBy(measure).agg(*(F.sum(x).alias(f"t{a}") for x, a in ((u, "s"), (u * u, "q"), (ue, "se"))))
    if measures is not None:
        total = measures.join(total, measure, "left").fillna(0.0, ["ts", "tq", "tse"])
    sizes = members.groupBy(group).agg(F.count(F.lit(1)).alias("n_in"), F.sum(even).alias("e_in"))
    grid = sizes.crossJoin(F.broadcast(n_all)).where("n_in >= 2 AND n_pool - n_in >= 2").crossJoin(total)  # groups x measures: the output's own size
    g = grid.join(inside, [group, measure], "left").fillna(0.0, ["s", "q", "se"])
    n_in, n_out = F.col("n_in"), F.col("n_pool") - F.col("n_in")
    out_s, out_q = F.col("ts") - F.col("s"), F.col("tq") - F.col("q")
    g = g.withColumn("n_out", n_out).withColumn("v_in", variance(n_in, F.col("s"), F.col("q"))).withColumn("v_out", variance(n_out, out_s, out_q)).withColumn("u_in", F.col("s") / n_in).withColumn("u_out", out_s / n_out).withColumn("delta", F.col("u_in") - F.col("u_out"))
    test: list[Column] = [F.col("delta"), F.col("v_in"), n_in, F.col("v_out"), F.col("n_out")]
    keep = [group, measure, "n_in", "n_out", "u_in", "u_out", "delta", welch_z(*test).alias("z_score"), cohens_d(*test).alias("cohens_d")]
    if split:
        a_in, b_in = F.col("e_in"), n_in - F.col("e_in")
        a_out, b_out = F.col("n_even") - a_in, F.col("n_odd") - b_in
        half = lambda ni, si, no, so: F.when((ni > 0) & (no > 0), mean(ni, si) - mean(no, so)).otherwise(F.lit(0.0))
        a = half(a_in, F.col("se"), a_out, F.col("tse") - F.col("se"))
        b = half(b_in, F.col("s") - F.col("se"), b_out, out_s - (F.col("tse") - F.col("se")))
        keep += [a.alias("delta_a"), b.alias("delta_b")]
    return g.select(*keep)


def consistency(grid: DataFrame, eps: float = 1e-12) -> DataFrame:
    """grid with sign_consistent, delta_min and is_chosen_leaning from the two halves."""
    a, b = F.col("delta_a"), F.col("delta_b")
    return grid.withColumn("sign_consistent", (F.abs(a) > eps) & (F.abs(b) > eps) & (F.signum(a) == F.signum(b))).withColumn("delta_min", F.least(F.abs(a), F.abs(b))).withColumn("is_chosen_leaning", F.col("delta") > 0)


def pool_size(pool: DataFrame) -> DataFrame:
    """n_pool, n_even, n_odd of rows(row_idx)."""
    even = F.coalesce(F.sum((F.col("row_idx") % 2 == 0).cast("int")), F.lit(0))
    return pool.agg(F.count(F.lit(1)).alias("n_pool"), even.alias("n_even"), (F.count(F.lit(1)) - even).alias("n_odd"))
