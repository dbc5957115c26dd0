"""Trends and anomalies of metric series: rows of key columns, time and value."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from signalbook.functions.values import half_up
from signalbook.operators.positions import number_rows
from signalbook.operators.shape import join_keys
from signalbook.session import cut_lineage


def metric_series(
    events: DataFrame, keys: Sequence[str], time: str, value: str, every: str = "hour"
) -> DataFrame:
    """Sum and count of a value per key and calendar unit, summed exactly."""
    total = F.sum(F.col(value).cast("decimal(18,4)"))
    return (
        events.groupBy(*keys, F.date_trunc(every, time).cast("timestamp_ntz").alias("t"))
        .agg(total.cast("double").alias("value"), F.count("*").alias("n_events"))
    )


def trend(
    series: DataFrame,
    keys: Sequence[str],
    chunk: Column,
    time: str = "t",
    value: str = "value",
    min_points: int = 3,
) -> DataFrame:
    """Least-squares trend of the value over its position in the series."""
    placed = number_rows(series, keys, [time], chunk, "_pos")
    v, pos = F.col(value), F.col("_pos").cast("double")
    first, last = F.col("first_value"), F.col("last_value")
    constant = F.col("_low") == F.col("_high")
    fit = (
        placed.groupBy(*keys)
        .agg(
            F.count("*").alias("points"),
            F.regr_slope(v, pos).alias("_slope"),
            F.regr_r2(v, pos).alias("_r2"),
            F.min_by(value, time).alias("first_value"),
            F.max_by(value, time).alias("last_value"),
            F.min(v).alias("_low"),
            F.max(v).alias("_high"),
        )
        .filter(F.col("points") >= min_points)
        # An exactly constant series has no slope and explains nothing.
        .withColumn("_slope", F.when(constant, 0.0).otherwise(F.col("_slope")))
        .withColumn("_r2", F.when(constant, 0.0).otherwise(F.col("_r2")))
        .withColumn(
            "_pct", F.when(first != 0, (last - first) / F.abs(first) * 100).otherwise(F.lit(0.0))
        )
    )
    direction = (
        F.when(F.abs("_pct") < 5, "STABLE")
        .when(F.col("_slope") > 0, "INCREASING")
        .otherwise("DECREASING")
    )
    return fit.select(
        *keys,
        "points",
        direction.alias("direction"),
        half_up(F.col("_slope"), 4).alias("slope"),
        half_up(F.col("_r2"), 3).alias("r_squared"),
        half_up(F.col("_pct"), 1).alias("pct_change"),
        "first_value",
        "last_value",
        half_up(F.least(F.lit(0.95), 0.5 + F.abs("_r2") * 0.45), 6).alias("confidence"),
    )


def _deviation(value: Column, expected: Column) -> Column:
    return half_up(
        F.when(expected != 0, (value - expected) / F.abs(expected) * 100).otherwise(F.lit(0.0)), 1
    )


def zscore_anomalies(
    series: DataFrame,
    keys: Sequence[str],
    value: str = "value",
    threshold: float = 2.5,
    high: float = 3.5,
    stats: DataFrame | None = None,
) -> DataFrame:
    """Points far from their series mean, in sample standard deviations.

    The statistics are one combined aggregate per series joined back to its
    rows; ``stats`` takes them from elsewhere (a stored history, say).
    """
    if stats is None:
        stats = series_stats(series, keys, value)
    v = F.col(value)
    z = F.abs(v - F.col("_mean")) / F.col("_sd")
    return (
        join_keys(series, stats.filter((F.col("_n") >= 5) & (F.col("_sd") > 0)), keys)
        .withColumn("_z", z)
        .filter(F.col("_z") >= threshold)
        .withColumn("expected", half_up(F.col("_mean"), 2))
        .withColumn("z_score", half_up(F.col("_z"), 2))
        .withColumn("deviation_pct", _deviation(v, F.col("_mean")))
        .withColumn("method", F.lit("zscore"))
        .withColumn("severity", F.when(F.col("_z") > high, "HIGH").otherwise("MEDIUM"))
        .drop("_mean", "_sd", "_n", "_z")
    )


def series_stats(series: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    return series.groupBy(*keys).agg(
        F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_sd"), F.count(value).alias("_n")
    )


def moments(series: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Count, mean and sum of squared deviations per series; these merge (see :func:`merge_moments`)."""
    return series.groupBy(*keys).agg(
        F.count(value).alias("n"),
        F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"),
        F.coalesce(F.var_pop(value) * F.count(value), F.lit(0.0)).alias("m2"),
    )


def merge_moments(one: DataFrame, two: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The moments of both together: the means' difference gives what lies between them."""
    null_safe = [one[k].eqNullSafe(two[k]) for k in keys]
    zero = lambda df, name: F.coalesce(df[name], F.lit(0))
    a, b = (zero(df, "n") for df in (one, two))
    ma, mb = (zero(df, "mean") for df in (one, two))
    n, apart = a + b, mb - ma
    joined = one.join(two, null_safe, "full")
    share = F.when(n > 0, b / n).otherwise(0.0)
    return joined.select(
        *[F.coalesce(one[k], two[k]).alias(k) for k in keys],
        n.alias("n"),
        (ma + apart * share).alias("mean"),
        (zero(one, "m2") + zero(two, "m2") + apart * apart * a * share).alias("m2"),
    )


def stats_of(found: DataFrame) -> DataFrame:
    """Moments as the statistics that :func:`zscore_anomalies` takes."""
    sd = F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1)))
    return found.withColumn("_sd", sd).withColumnsRenamed({"mean": "_mean", "n": "_n"}).drop("m2")


#: Parts into which a round of the selection cuts the range that holds a rank.
BINS = 1024


def _magnitude(v: Column) -> Column:
    """A scale that rises with the value by octaves, through zero."""
    octave = F.least(F.log2(F.abs(v)), F.lit(1100.0)) + 1075
    return F.when(v == 0, 0.0).otherwise(F.signum(v) * octave)


def _bin(v: Column, lo: Column, hi: Column) -> Column:
    """Part of the range that a value falls into; both ends have parts of their own, -1 is below.

    Parts are of equal width, or of equal ratio where the range spans many octaves, so that a few
    rounds do for values of any size.
    """
    wide = (F.signum(lo) != F.signum(hi)) | (F.greatest(F.abs(lo), F.abs(hi)) / 16 > F.least(F.abs(lo), F.abs(hi)))
    # Halves, so that no difference overflows; a range too narrow to divide is one part.
    share = F.when(wide, F.try_divide(_magnitude(v) - _magnitude(lo), _magnitude(hi) - _magnitude(lo))).otherwise(
        F.try_divide(v / 2 - lo / 2, hi / 2 - lo / 2)
    )
    inner = F.when(share.isNull() | F.isnan(share), 1).otherwise(F.greatest(F.lit(1), F.least(F.lit(BINS - 2), F.floor(share * BINS))))
    return F.when(v < lo, -1).when(v == lo, 0).when(v == hi, BINS - 1).otherwise(inner).cast("int")


def values_at_ranks(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    ranks: Mapping[str, tuple[float, Callable[[Column], Column]]],
    accuracy: int = 10000,
) -> DataFrame:
    """Exact values at given 0-based ranks of each group with its size ``_n``, without sorting a group.

    ``ranks`` names each target with its approximate share and its exact rank as a function of the row
    count.  A mergeable sketch gives each target a first range, most likely a narrow one.  Then, in
    rounds of one scan, the values are counted by parts of the range (and below it); the part whose
    counts enclose the rank gives, with the values it really holds, the next range.  A sketch that
    missed the rank is thus noticed and put right.  A round divides the rows in range by about a
    thousand; it ends when a range is a single value, however many rows have that value.  Nothing
    larger than the list of parts is ordered.
    """
    margin = 4.0 / accuracy
    v = F.col(value)
    rows = df.where(v.isNotNull()).select(*keys, v.alias("_v"))
    shares = [min(1.0, max(0.0, share + side * margin)) for share, _ in ranks.values() for side in (-1, 1)]
    sketch = rows.groupBy(*keys).agg(
        F.count("_v").alias("_n"),
        F.min("_v").alias("_min"),
        F.max("_v").alias("_max"),
        F.percentile_approx("_v", shares, accuracy).alias("_q"),
    )
    targets = [
        F.struct(F.lit(name).alias("_name"), exact(F.col("_n")).cast("long").alias("_rank"), F.col("_q")[2 * i].alias("_lo"), F.col("_q")[2 * i + 1].alias("_hi"))
        for i, (name, (_, exact)) in enumerate(ranks.items())
    ]
    target = [*keys, "_n", "_max", "_name", "_rank", "_lo", "_hi"]
    todo = cut_lineage(sketch.select(*keys, "_n", "_max", F.inline(F.array(*targets))).where("_rank >= 0 AND _rank < _n"))
    found = []
    while not todo.isEmpty():
        listed = todo.groupBy(*keys).agg(F.collect_list(F.struct(*target[len(keys) :])).alias("_todo"))
        counted = (
            join_keys(rows, listed, keys)
            # One row per target that the value can still decide, not one per target.
            .select(*keys, "_v", F.explode(F.filter("_todo", lambda t: F.col("_v") <= t["_hi"])).alias("_t"))
            .select(*keys, "_t.*", "_v", _bin(F.col("_v"), F.col("_t._lo"), F.col("_t._hi")).alias("_bin"))
            .groupBy(*target, "_bin")
            .agg(F.count("_v").alias("_c"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
        )
        upto = Window.partitionBy(*target).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
        encloses = (F.col("_cum") > F.col("_rank")) & (F.col("_cum") - F.col("_c") <= F.col("_rank"))
        step = (
            counted.withColumn("_cum", F.sum("_c").over(upto))
            .groupBy(*target)
            .agg(F.max(F.when(encloses, F.struct("_least", "_most"))).alias("_next"))
            # No part encloses the rank: it lies above the range.
            .withColumn("_lo", F.coalesce("_next._least", "_hi"))
            .withColumn("_hi", F.coalesce("_next._most", "_max"))
        )
        step = cut_lineage(step.select(*target, F.col("_next").isNull().alias("_missed")))
        done = (F.col("_lo") == F.col("_hi")) & ~F.col("_missed")
        found.append(step.where(done).drop("_missed"))
        todo = step.where(~done).drop("_missed")
    found = reduce(DataFrame.unionByName, found, todo)
    return found.groupBy(*keys).agg(
        F.max("_n").alias("_n"), *[F.max(F.when(F.col("_name") == name, F.col("_lo"))).alias(name) for name in ranks]
    )


def quartiles(series: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Nearest-rank quartiles (sorted[n//4], sorted[3n//4]) and the exact median."""
    found = values_at_ranks(
        series,
        keys,
        value,
        {
            "q1": (0.25, lambda n: F.floor(n / 4)),
            "q3": (0.75, lambda n: F.floor(n * 3 / 4)),
            "_m1": (0.5, lambda n: F.floor((n - 1) / 2)),
            "_m2": (0.5, lambda n: F.floor(n / 2)),
        },
    )
    return found.withColumn("median", (F.col("_m1") + F.col("_m2")) / 2).drop("_m1", "_m2")


def iqr_anomalies(
    series: DataFrame, keys: Sequence[str], value: str = "value", k: float = 1.5
) -> DataFrame:
    """Points outside the quartile fences; the expected value is the median."""
    spread = F.col("q3") - F.col("q1")
    fences = (
        quartiles(series, keys, value)
        .filter(F.col("_n") >= 5)
        .withColumn("_lower", F.col("q1") - k * spread)
        .withColumn("_upper", F.col("q3") + k * spread)
    )
    v, lower, upper = F.col(value), F.col("_lower"), F.col("_upper")
    return (
        join_keys(series, fences, keys)
        .filter((v < lower) | (v > upper))
        .withColumn("expected", half_up(F.col("median"), 2))
        .withColumn("lower_bound", half_up(lower, 2))
        .withColumn("upper_bound", half_up(upper, 2))
        .withColumn("deviation_pct", _deviation(v, F.col("median")))
        .withColumn("method", F.lit("iqr"))
        .withColumn(
            "severity", F.when((v > upper * 2) | (v < lower / 2), "HIGH").otherwise("MEDIUM")
        )
        .drop("q1", "q3", "median", "_n", "_lower", "_upper")
    )


def rolling_anomalies(
    series: DataFrame,
    keys: Sequence[str],
    chunk: Column,
    time: str = "t",
    value: str = "value",
    width: int = 24,
    threshold_pct: float = 50.0,
    block: int = 100_000,
) -> DataFrame:
    """Points that leave the mean of the ``width`` points before them by a given share.

    A long series is cut into blocks of consecutive points; each block also gets
    the last ``width`` points of the block before it, so no window spans blocks.
    """
    block = max(block, width)
    pos = F.col("_pos") - 1
    own = F.floor(pos / block)
    placed = number_rows(series, keys, [time], chunk, "_pos")
    copies = F.when(pos % block >= block - width, F.array(own, own + 1)).otherwise(F.array(own))
    cut = placed.withColumn("_block", F.explode(copies))
    before = Window.partitionBy(*keys, "_block").orderBy("_pos").rowsBetween(-width, -1)
    v, mean = F.col(value), F.col("_mean")
    return (
        cut.withColumn("_mean", F.avg(value).over(before))
        .withColumn("_seen", F.count(value).over(before))
        .filter((own == F.col("_block")) & (F.col("_seen") == width) & (mean != 0))
        .withColumn("expected", half_up(mean, 2))
        .withColumn("deviation_pct", _deviation(v, mean))
        .filter(F.abs(half_up((v - mean) / F.abs(mean) * 100, 6)) >= threshold_pct)
        .withColumn("method", F.lit("rolling_average"))
        .drop("_pos", "_block", "_mean", "_seen")
    )
