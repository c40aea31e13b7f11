"""Association statistics over distributed cells; Python meets slices of cells in tasks, and finished one-row results."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.functions.pvalues import chi2_tail, f_tail
from recordloom.operators.frequency import only_top, present, regroup
from recordloom.operators.ranking import average_ranks, running_total, value_cells
from recordloom.session import settle


def _pearson(df: DataFrame, pairs: Sequence[tuple[str, str]], by: Sequence[str]) -> DataFrame:
    """Correlations of the listed pairs: one aggregate row, laid out as one row per pair."""
    every = {tuple(sorted(p)) for p in pairs}
    value = {p: F.corr(F.col(p[0]).cast("double"), F.col(p[1]).cast("double")).alias(f"{p[0]}|{p[1]}") for p in sorted(every)}
    row = df.groupBy(*by).agg(*value.values())
    entries = [
        F.struct(F.lit(a).alias("left_column"), F.lit(b).alias("right_column"), F.col("`" + "|".join(sorted((a, b))) + "`").alias("corr"))
        for a, b in pairs
    ]
    return row.select(*by, F.inline(F.array(*entries)))


def pearson(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation of every column pair in one pass, pairs with a null skipped."""
    return _pearson(df, list(combinations(columns, 2)), by)


def pearson_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Full symmetric matrix in long form, the diagonal included, from one pass."""
    return _pearson(df, list(product(columns, repeat=2)), ())


def strongest_pairs(df: DataFrame, columns: Sequence[str], k: int = 5) -> DataFrame:
    """Column pairs with the largest absolute correlation."""
    order = [F.desc(F.abs("corr")), F.asc("left_column"), F.asc("right_column")]
    return pearson(df, columns).orderBy(*order).limit(k)


def _pair_cells(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Row counts ``n`` per pair number ``_pair`` and pair of values ``a``, ``b``, nulls skipped.

    The cells are settled: ranks and sums read them several times.
    """
    pairs = [
        F.struct(F.lit(i).alias("_pair"), F.col(x).cast("double").alias("a"), F.col(y).cast("double").alias("b"))
        for i, (x, y) in enumerate(combinations(columns, 2))
    ]
    long = present(df, *by).select(*by, F.inline(F.array(*pairs)))
    return settle(present(long, "a", "b").groupBy(*by, "_pair", "a", "b").agg(F.count(F.lit(1)).alias("n")))


def _name_pairs(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Replace the pair number by the names of both columns."""
    names = list(zip(*combinations(columns, 2)))
    sides = [F.array(*[F.lit(c) for c in side])[F.col("_pair")] for side in names]
    return df.select(*by, sides[0].alias("left_column"), sides[1].alias("right_column"), "corr")


def _fewer_values_last(cells: DataFrame) -> DataFrame:
    """Put the side with fewer values into ``b``, pair by pair; one row per pair reaches the driver."""
    wide = F.approx_count_distinct("b") > F.approx_count_distinct("a")
    turned = [row["_pair"] for row in cells.groupBy("_pair").agg(wide.alias("wide")).collect() if row["wide"]]
    turn = F.col("_pair").isin(turned)
    others = [c for c in cells.columns if c not in ("a", "b")]
    return cells.select(
        *others, F.when(turn, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(turn, F.col("a")).otherwise(F.col("b")).alias("b")
    )


def spearman(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Spearman correlation of every column pair with average ranks on ties."""
    keys = [*by, "_pair"]
    cells = _pair_cells(df, columns, by)

    def ranks(side: str) -> DataFrame:
        weights = cells.groupBy(*keys, side).agg(F.sum("n").alias("n"))
        centred = F.col("avg_rank") - (F.col("total") + 1) / 2
        return average_ranks(weights, side, keys).select(*keys, side, centred.alias(f"_{side}"))

    ranked = cells.join(ranks("a"), [*keys, "a"]).join(ranks("b"), [*keys, "b"])
    n, x, y = F.col("n"), F.col("_a"), F.col("_b")
    sums = ranked.groupBy(*keys).agg(
        F.sum(n * x * y).alias("xy"), F.sum(n * x * x).alias("xx"), F.sum(n * y * y).alias("yy")
    )
    corr = F.try_divide(F.col("xy"), F.sqrt(F.col("xx")) * F.sqrt(F.col("yy")))
    return _name_pairs(sums.withColumn("corr", corr), columns, by)


#: Cells of one slice, within which pairs are counted at once.
SLICE = 1 << 20


def _pairs_ahead(group: np.ndarray, y: np.ndarray, n: np.ndarray, groups: int) -> np.ndarray:
    """Per group the weighted pairs of rows of which the later has the greater ``y``.

    Two ranks differ first at exactly one binary digit: among rows that share the
    leading digits, every row with digit one meets the running count of those with zero.
    """
    rank = np.unique(y, return_inverse=True)[1].astype(np.int64)
    out, digits = np.zeros(groups), int(rank.max(initial=0)).bit_length()
    at = (group.astype(np.int64) << digits) + rank
    for digit in range(digits - 1, -1, -1):
        lead = at >> (digit + 1)
        order = np.argsort(lead, kind="stable")
        lead, one, weight = lead[order], (at[order] >> digit & 1).astype(bool), n[order]
        zeros = np.where(one, 0, weight)
        before = np.cumsum(zeros) - zeros
        first = np.flatnonzero(np.append(True, lead[1:] != lead[:-1]))
        since = np.repeat(before[first], np.diff(np.append(first, len(lead))))
        smaller = (before - since)[one].astype(float)
        out += np.bincount(group[order][one], weight[one] * smaller, groups)
    return out


def _sliced(rows: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Slices of the order by ``x`` within ``keys``: the ``pairs`` with both greater inside each, and ``n`` per slice and ``y``.

    Equal ``x`` are ordered by falling ``y``, so that no pair of them counts and a
    value may lie in several slices.  Slices are numbered along the order.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, number, held, size = TaskContext.get().partitionId() << 32, 0, [], 0

        def slice_of(table: pa.Table) -> pa.RecordBatch:
            codes = [table.column(k).combine_chunks().dictionary_encode().indices.to_numpy() for k in keys]
            new = np.zeros(table.num_rows, bool)
            new[0] = True
            for code in codes:
                new[1:] |= code[1:] != code[:-1]
            group, heads = np.cumsum(new) - 1, np.flatnonzero(new)
            value, n = table.column("y").to_numpy(), table.column("n").to_numpy()
            pairs = _pairs_ahead(group, value, n, len(heads))
            ranks = np.unique(value, return_inverse=True)[1]
            order = np.lexsort((ranks, group))
            first = np.flatnonzero(np.append(True, (np.diff(group[order]) != 0) | (np.diff(ranks[order]) != 0)))
            some = order[first]
            sums = np.add.reduceat(n[order], first)
            # The pairs of a group come with the first of its values.
            lead = np.append(True, np.diff(group[some]) != 0)
            own = np.where(lead, pairs[group[some]], 0.0)
            picked = table.select(list(keys)).take(pa.array(some))
            columns = [c.combine_chunks() for c in picked.columns]
            columns += [pa.array(np.full(len(some), base + number)), pa.array(value[some]), pa.array(sums), pa.array(own)]
            return pa.RecordBatch.from_arrays(columns, names=[*keys, "slice", "y", "n", "pairs"])

        for batch in batches:
            held, size = [*held, batch], size + batch.num_rows
            if size >= SLICE:
                yield slice_of(pa.Table.from_batches(held))
                held, size, number = [], 0, number + 1
        if size:
            yield slice_of(pa.Table.from_batches(held))

    order = [*[F.col(k) for k in keys], F.col("x"), F.desc("y")]
    narrow = rows.select(*keys, F.col(x).alias("x"), F.col(y).alias("y"), "n")
    kinds = [f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys]
    schema = ", ".join([*kinds, "slice long", f"y {rows.schema[y].dataType.simpleString()}", "n long", "pairs double"])
    return settle(narrow.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(counted, schema))


def _between_slices(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per ``keys`` the ``pairs`` of which ``slice`` and ``y`` are both greater; there are as many rows as pairs of slices."""

    def met(table: pa.Table) -> pa.Table:
        rows, columns = (np.unique(table.column(c).to_numpy(), return_inverse=True)[1] for c in ("slice", "y"))
        grid = np.zeros((rows.max() + 1, columns.max() + 1))
        np.add.at(grid, (rows, columns), table.column("n").to_numpy())
        before = np.zeros_like(grid)
        before[1:, 1:] = grid.cumsum(axis=0).cumsum(axis=1)[:-1, :-1]
        picked = table.select(list(keys)).slice(0, 1)
        return picked.append_column("pairs", pa.array([float((grid * before).sum())]))

    kinds = [f"`{k}` {cells.schema[k].dataType.simpleString()}" for k in keys]
    return cells.groupBy(*keys).applyInArrow(met, ", ".join([*kinds, "pairs double"]))


def kendall(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Kendall tau-b of every column pair, without listing pairs of rows.

    A pair of cells is concordant when ``a`` and ``b`` both grow.  Cells are cut into
    slices along ``a``; pairs within a slice are counted in its task.  Pairs of two
    slices are concordant when the slice and ``b`` both grow, so the counts per slice
    and ``b`` are cut along ``b`` in turn, and what is left is one count for each
    slice of either kind.
    """
    keys = [*by, "_pair"]
    cells = _fewer_values_last(_pair_cells(df, columns, by))
    along_a = _sliced(cells, keys, "a", "b")
    along_b = _sliced(along_a, keys, "y", "slice")
    found = [f.select(*keys, "pairs") for f in (along_a, along_b, _between_slices(along_b, keys))]
    concordant = found[0].unionByName(found[1]).unionByName(found[2]).groupBy(*keys).agg(F.sum("pairs").alias("concordant"))

    def ties(frame: DataFrame, size: str, name: str) -> DataFrame:
        n = F.col(size).cast("double")
        return frame.groupBy(*keys).agg(F.sum(n * (n - 1) / 2).alias(name))

    def tied(frame: DataFrame, *columns: str) -> DataFrame:
        return ties(frame.groupBy(*keys, *columns).agg(F.sum("n").alias("_n")), "_n", "ties_" + "".join(columns))

    per_b = along_a.select(*keys, F.col("y").alias("b"), "n")
    sums = tied(per_b).join(tied(cells, "a"), keys).join(tied(per_b, "b"), keys).join(ties(cells, "n", "ties_ab"), keys)
    sums = sums.join(concordant, keys, "left").withColumn("concordant", F.coalesce("concordant", F.lit(0.0)))
    untied = F.col("ties_") - F.col("ties_a") - F.col("ties_b") + F.col("ties_ab")
    scale = F.sqrt(F.col("ties_") - F.col("ties_a")) * F.sqrt(F.col("ties_") - F.col("ties_b"))
    corr = F.try_divide(2 * F.col("concordant") - untied, scale)
    return _name_pairs(sums.withColumn("corr", corr), columns, by)


def linear_trend(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares line of ``y`` on ``x`` in one pass."""
    fx, fy = F.col(x).cast("double"), F.col(y).cast("double")
    return df.agg(
        F.regr_count(fy, fx).alias("n"),
        F.regr_slope(fy, fx).alias("slope"),
        F.regr_intercept(fy, fx).alias("intercept"),
        F.regr_r2(fy, fx).alias("r2"),
    )


def fitted_line(df: DataFrame, x: str, y: str) -> DataFrame:
    """Every distinct ``x`` with its value on the fitted line."""
    line = linear_trend(df, x, y).select(F.struct("slope", "intercept").alias("line")).scalar()
    points = present(df, x, y).select(x).distinct().withColumn("_line", line)
    return points.select(x, (F.col("_line.slope") * F.col(x) + F.col("_line.intercept")).alias("fitted"))


def anova(df: DataFrame, group: str, measure: str, top: int | None = None) -> DataFrame:
    """One-way analysis of variance over all, or the ``top`` most frequent, groups."""
    rows = settle(
        present(df, group).groupBy(group).agg(
            F.count(F.lit(1)).alias("n"),
            F.count(measure).alias("size"),
            F.avg(measure).alias("mean"),
            F.var_samp(measure).alias("variance"),
        )
    )
    groups = (only_top(rows, rows, group, top) if top else rows).filter(F.col("size") > 0)
    grand = groups.agg((F.sum(F.col("size") * F.col("mean")) / F.sum("size")).alias("grand")).scalar()
    gap = F.col("mean") - F.col("_grand")
    sums = groups.withColumn("_grand", grand).agg(
        F.sum(F.col("size") * gap * gap).alias("between"),
        F.sum((F.col("size") - 1) * F.coalesce("variance", F.lit(0.0))).alias("within"),
        (F.count(F.lit(1)) - 1).alias("df_between"),
        (F.sum("size") - F.count(F.lit(1))).alias("df_within"),
    )
    f = F.try_divide(F.col("between") / F.col("df_between"), F.col("within") / F.col("df_within"))
    return sums.filter(F.col("df_between") > 0).select(
        f.alias("f_statistic"), "df_between", "df_within"
    ).withColumn("p_value", f_tail(F.col("f_statistic"), F.col("df_between"), F.col("df_within")))


def kruskal(df: DataFrame, group: str, measure: str) -> DataFrame:
    """Kruskal-Wallis H with tie correction."""
    cells = settle(value_cells(df, measure, [group]))
    weights = cells.groupBy(measure).agg(F.sum("n").alias("n"))
    ranked = average_ranks(weights, measure).withColumnRenamed("n", "tied")
    t = F.col("tied").cast("double")
    ties = ranked.agg(F.struct(F.sum(t * t * t - t).alias("ties"), F.sum("tied").alias("rows")).alias("s")).scalar()
    groups = (
        cells.join(ranked.select(measure, "avg_rank"), measure)
        .groupBy(group)
        .agg(F.sum("n").alias("size"), F.sum(F.col("n") * F.col("avg_rank")).alias("rank_sum"))
    )
    rows = F.col("_all.rows").cast("double")
    gap = F.col("rank_sum") / F.col("size") - (rows + 1) / 2
    sums = groups.withColumn("_all", ties).agg(
        F.sum(F.col("size") * gap * gap).alias("spread"),
        (F.count(F.lit(1)) - 1).alias("dof"),
        F.max(rows).alias("rows"),
        F.max("_all.ties").alias("ties"),
    )
    n = F.col("rows")
    correction = 1 - F.try_divide(F.col("ties"), n * n * n - n)
    h = F.try_divide(F.col("spread") * 12 / (n * (n + 1)), correction)
    return sums.filter(F.col("dof") > 0).select(h.alias("h_statistic"), "dof").withColumn(
        "p_value", chi2_tail(F.col("h_statistic"), F.col("dof"))
    )


def chi2_independence(cells: DataFrame, row: str, column: str, correction: bool = True) -> DataFrame:
    """Chi-square test of independence on counts ``n``; one degree of freedom gets Yates' correction.

    Pairs that never occur need no row: each adds its expected count, and all
    expected counts sum to the number of cases.
    """
    seen = settle(regroup(cells, row, column))
    rows = regroup(seen, row).withColumnRenamed("n", "row_n")
    columns = regroup(seen, column).withColumnRenamed("n", "column_n")
    margins = F.struct(F.count(F.lit(1)).alias("k"), F.sum("m").alias("cases"), F.sum(1 / F.col("m")).alias("inverse"))
    row_side = rows.select(F.col("row_n").alias("m")).agg(margins.alias("s")).scalar()
    column_side = columns.select(F.col("column_n").alias("m")).agg(margins.alias("s")).scalar()
    joined = seen.join(rows, row).join(columns, column).withColumn("_r", row_side).withColumn("_c", column_side)
    expected = F.col("row_n").cast("double") * F.col("column_n") / F.col("_r.cases")
    gap = F.col("n") - F.col("expected")
    sums = joined.withColumn("expected", expected).agg(
        F.sum(gap * gap / F.col("expected")).alias("seen"),
        F.sum("expected").alias("seen_expected"),
        F.max(F.abs(gap)).alias("gap"),
        F.max("_r").alias("r"),
        F.max("_c").alias("c"),
    )
    cases = F.col("r.cases").cast("double")
    plain = F.col("seen") + F.greatest(cases - F.col("seen_expected"), F.lit(0.0))
    reduced = F.col("gap") - F.least(F.lit(0.5), F.col("gap"))
    yates = reduced * reduced * cases * F.col("r.inverse") * F.col("c.inverse")
    dof = (F.col("r.k") - 1) * (F.col("c.k") - 1)
    statistic = F.when((dof == 1) & F.lit(correction), yates).otherwise(plain)
    return sums.select(statistic.alias("chi2"), dof.alias("dof")).withColumn(
        "p_value", F.when(F.col("dof") > 0, chi2_tail(F.col("chi2"), F.col("dof"))).otherwise(F.lit(1.0))
    )
