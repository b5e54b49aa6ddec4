"""Rolling features of accounts: counts, means and deviations over the last days of each event.

A frame over time is a difference of two running sums: that at the event and that just before the frame begins. Running sums of one account
are made in blocks of time, so an account that holds a third of all rows is worked off by as many tasks as it has blocks:

1. events of one account and time are added up before they move,
2. every such point asks for the running sum at the begin of each of its frames (a probe); points and probes of one (account, block) get running
   sums within the block from a window,
3. the sums of whole blocks, a few rows for each account, get running sums of their own, with which the blocks begin,
4. the answers of a point meet again by (account, time).

Sums are decimals, so they are exact in any order and a difference of long sums loses nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from dialoom.functions.dims import written

DAYS = (1, 7, 30)
TASK_ROWS = 1 << 19
BLOCK_ROWS = 1 << 16        # points that a block would hold if one account held all of them


def _micros(time: Column) -> Column:
    return F.unix_micros(time.cast("timestamp"))


def task_count(points: DataFrame, frames: int) -> int:
    """Tasks of the shuffles, so that one holds about ``TASK_ROWS`` points, probes or events, whatever the size of the table."""
    n, events = points.agg(F.count("*"), F.sum("n")).first()
    return max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-max(n * (frames + 2), events or 0) // TASK_ROWS))


def block_width(points: DataFrame, rows: int = BLOCK_ROWS) -> int:
    """Microseconds of a block, so that an account with all points would have about ``rows`` of them in each; one scan for four numbers."""
    n, first, last = points.agg(F.count("*"), F.min("at"), F.max("at")).first()
    return max(1, ((last - first + 1) * rows) // max(1, n)) if n and first is not None else 1


def running_sums(points: DataFrame, frames: dict[str, int], width: int, tasks: int) -> DataFrame:
    """(account, at, name, n, m, s, q) for every point (account, at, n, m, s, q) and frame: the sums over [at - length, at].

    ``frames`` maps names to lengths in microseconds; the frame "" is added: all that came before ``at``. ``at`` is distinct within an account.
    The sums are made by ``tasks`` tasks.
    """
    parts = ["n", "m", "s", "q"]
    zero = [F.lit(0).cast(points.schema[c].dataType).alias(c) for c in parts]
    # a probe stands before the points of its own time, so their running sum leaves them out; the point itself keeps them
    asked = F.array(F.struct(F.lit(0).cast("bigint").alias("back"), F.lit("").alias("name")),
                    *[F.struct(F.lit(v).cast("bigint").alias("back"), F.lit(k).alias("name")) for k, v in frames.items()])
    probes = points.select("account", "at", F.inline(asked)).select("account", "at", (F.col("at") - F.col("back")).alias("place"), F.lit(0).alias("kind"), "name", *zero)
    rows = points.select("account", "at", F.col("at").alias("place"), F.lit(1).alias("kind"), F.lit(None).cast("string").alias("name"), *parts).union(probes)
    rows = rows.withColumn("block", F.floor(F.col("place") / F.lit(width)))
    # one row for each account and block, at most span / width for any account: what came before the block opens its running sums
    before = Window.partitionBy("account").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("account", "block").agg(*[F.sum(c).cast(points.schema[c].dataType).alias(c) for c in parts])
    opened = blocks.select("account", F.lit(None).cast("bigint").alias("at"), F.lit(None).cast("bigint").alias("place"), F.lit(-1).alias("kind"),
                           F.lit(None).cast("string").alias("name"), *[F.coalesce(F.sum(c).over(before), F.lit(0)).cast(points.schema[c].dataType).alias(c) for c in parts], "block")
    inside = Window.partitionBy("account", "block").orderBy(F.asc_nulls_first("place"), "kind").rowsBetween(Window.unboundedPreceding, 0)
    known = rows.union(opened).repartition(tasks, "account", "block").select("account", "at", "kind", "name", *[F.sum(c).over(inside).alias(c) for c in parts]).filter("kind >= 0")
    # the answers of a point: all sums come from one row each, so max picks it
    def of(name: str | None, c: str) -> Column:
        mine = F.col("kind") == 1 if name is None else (F.col("kind") == 0) & (F.col("name") == name)
        return F.max(F.when(mine, F.col(c)))

    wide = known.repartition(tasks, "account", "at").groupBy("account", "at").agg(*[of(k, c).alias(f"{c}_{i}") for i, k in enumerate([None, "", *frames]) for c in parts])
    cut = [F.struct(F.lit("").alias("name"), *[F.col(f"{c}_1").alias(c) for c in parts])]
    cut += [F.struct(F.lit(k).alias("name"), *[(F.col(f"{c}_0") - F.col(f"{c}_{i + 2}")).alias(c) for c in parts]) for i, k in enumerate(frames)]
    return wide.select("account", "at", F.map_from_arrays(F.array(*[F.lit(k) for k in ["", *frames]]), F.array(*cut)).alias("frames"))


def rolling_features(events: DataFrame, account: str = "account", time: str = "ts", value: str = "amount", days: tuple[int, ...] = DAYS,
                     digits: int = 6, width: int | None = None) -> DataFrame:
    """``events`` with, for each d of ``days``, n_<d>d, mean_<d>d and std_<d>d over the account's events in the last d days, the event itself
    and others of its time included; history_n and history_mean over all that came before, deviation = value - history_mean; hour and weekday (1 = Monday).

    n counts events, the means and the deviation (of the population) leave out missing values: nulls, and values that are no finite number below
    10^(18 - digits). Values count with ``digits`` decimals. Events without a time get nulls. A null account is an account like others.
    Without values a mean is null; a deviation below 3e-7 of the root mean square is 0. ``width`` (microseconds of a block) follows the data if it is not given; it changes no result.
    Columns of ``events`` must not have the names of the new ones.
    """
    amount = F.expr(f"try_cast(`{value}` AS DECIMAL(18, {digits}))")
    rows = events.select(F.col(account).alias("account"), _micros(F.col(time)).alias("at"), amount.alias("v")).filter("at IS NOT NULL")
    points = rows.groupBy("account", "at").agg(F.count("*").alias("n"), F.count("v").alias("m"), F.coalesce(F.sum("v"), F.lit(0)).cast(f"decimal(38,{digits})").alias("s"),
                                               F.coalesce(F.sum(F.col("v").cast(f"decimal(19,{digits})") * F.col("v")), F.lit(0)).cast(f"decimal(38,{2 * digits})").alias("q"))
    points = written(points, "rolling-points")
    frames = {f"{d}d": d * 86_400_000_000 for d in days}
    tasks = task_count(points, len(frames))
    sums = running_sums(points, frames, width or block_width(points), tasks)
    # a struct of a null account equals another one, so both sides are dealt out by the plain keys of the join
    sums = sums.select(F.struct("account").alias("_account"), F.col("at").alias("_at"), "frames").repartition(tasks, "_account", "_at")
    keyed = events.withColumns({"_who": F.struct(F.col(account).alias("account")), "_when": _micros(F.col(time))})
    timed = keyed.filter("_when IS NOT NULL").repartition(tasks, "_who", "_when")
    found = timed.join(sums, (F.col("_who") == F.col("_account")) & (F.col("_when") == F.col("_at")), "left").select(*events.columns, "frames")
    joined = found.union(keyed.filter("_when IS NULL").select(*events.columns, F.lit(None).cast(found.schema["frames"].dataType).alias("frames")))
    out = {}
    for name in frames:
        f = F.col("frames")[name]
        mean = F.when(f["m"] > 0, f["s"].cast("double") / f["m"])
        squares = f["q"].cast("double") / f["m"]
        spread = squares - mean * mean
        out |= {f"n_{name}": f["n"], f"mean_{name}": mean, f"std_{name}": F.when(f["m"] > 0, F.when(spread > 1e-13 * squares, F.sqrt(spread)).otherwise(F.lit(0.0)))}
    past = F.col("frames")[""]
    out |= {"history_n": past["n"], "history_mean": F.when(past["m"] > 0, past["s"].cast("double") / past["m"])}
    out["deviation"] = F.col(value).cast("double") - out["history_mean"]
    out |= {"hour": F.hour(F.col(time)), "weekday": F.weekday(F.col(time)) + 1}
    return joined.withColumns(out).drop("frames")
