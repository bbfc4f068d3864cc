"""Race readiness, and how race predictions developed: for each period what would have been predicted at its end."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from paceline.functions.scalars import clamp, half_up, vdot, week_start
from paceline.operators.aggregates import period_start
from paceline.operators.joins import within_bands

#: Race distances in km, the margin within which a run counts as a race of that distance, and the share by which
#: a race takes longer without any preparation.
RACES = [(1.609, 0.04, 0.05), (5.0, 0.04, 0.08), (10.0, 0.04, 0.12), (15.0, 0.05, 0.15), (21.097, 0.05, 0.18), (30.0, 0.05, 0.22), (42.195, 0.05, 0.25)]
#: For each race its name, distance, and the ranges of weekly km, longest run and days a week of three levels.
REFERENCES = [
    ("Mile", 1.609, [(20, 40), (40, 65), (65, 130)], [(6, 8), (8, 10), (10, 14)], [(3, 4), (4, 5), (5, 7)]),
    ("5K", 5.0, [(15, 25), (25, 50), (50, 80)], [(8, 10), (10, 13), (13, 16)], [(3, 4), (4, 5), (5, 6)]),
    ("10K", 10.0, [(20, 40), (40, 65), (65, 96)], [(10, 13), (13, 16), (16, 19)], [(3, 4), (4, 5), (5, 6)]),
    ("Half Marathon", 21.097, [(20, 30), (30, 50), (50, 70)], [(13, 16), (16, 18), (18, 21)], [(3, 4), (4, 5), (5, 6)]),
    ("Marathon", 42.195, [(25, 40), (40, 65), (65, 95)], [(18, 22), (22, 27), (27, 32)], [(4, 5), (5, 6), (5, 7)]),
]
LEVELS = ("Beginner", "Intermediate", "Advanced")
#: Shares of the predictions, ordered by time, that are kept.
MOODS = {"optimistic": (0.0, 0.4), "realistic": (0.25, 0.75), "conservative": (0.6, 1.0)}
#: Newton's method settles after 17 steps at most for scores of 10 to 100 and these distances.
NEWTON_STEPS = 20
WEIGHTS = {"riegel": 30.0, "curve": 20.0, "best": 20.0, "vdot": 15.0, "readiness": 90.0}


def as_of_best(rows: DataFrame, keys: list[str], order: list[str], value: str, n: int) -> DataFrame:
    """``rows`` with ``best_1`` to ``best_n``: the n smallest of ``value`` among the rows up to each one in ``order``.

    A running minimum keeps the smallest; of each row and the minimum before it the larger one is passed on, and the
    running minimum of what is passed on is the second smallest, and so forth. Every step is a window of the same
    partitions and order, so n values cost one exchange and one sort, and no row meets another.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    now, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("_x", F.col(value))
    for k in range(1, n + 1):
        out = out.withColumns({f"best_{k}": F.min("_x").over(now), "_m": F.min("_x").over(before)}).withColumn("_x", F.when(F.col("_m").isNotNull(), F.greatest("_x", "_m")))
    return out.drop("_x", "_m")


def position(x: Column, levels: list[tuple[float, float]], always: bool) -> Column:
    """Score from 0 to 100 by the highest level whose range begins at or below ``x`` and the way through it; below all levels,
    and unless ``always`` also for a score of 0, up to 30 in proportion to the first level's begin."""
    low = F.greatest(F.lit(0.0), x / float(levels[0][0]) * 30)
    out = low
    for k, (a, b) in enumerate(levels):
        score = (k + F.least(F.lit(1.0), (x - a) / float(b - a))) / float(len(levels)) * 100
        out = F.when(x >= a, score if always or k else F.when((score == 0) & (x > 0), low).otherwise(score)).otherwise(out)
    return out


def training(runs: DataFrame, keys: list[str], weeks: int | None = None) -> DataFrame:
    """What ``keys`` trained: mean weekly km, longest run, days a week, share of active weeks (of ``weeks``, or of those with
    runs), change of the later half of the weeks against the earlier one, fast sessions a week. ``runs`` has ``keys, day,
    distance, moving_time``."""
    w = Window.partitionBy(*keys)
    km = F.coalesce(F.col("distance"), F.lit(0.0)) / 1000
    pace = F.when((F.col("distance") > 0) & (F.col("moving_time") > 0), F.col("moving_time") / (F.col("distance") / 1000))
    paced = runs.withColumn("_pace", pace).withColumn("_fast", (F.col("_pace") < F.avg("_pace").over(w) * 0.92).cast("int"))
    week = paced.groupBy(*keys, week_start(F.col("day")).alias("week")).agg(F.sum(km).alias("km"), F.max(km).alias("longest"), F.countDistinct("day").alias("days"), F.coalesce(F.sum("_fast"), F.lit(0)).alias("fast"), F.count("*").alias("runs"))
    mid = F.floor(F.count("*").over(w) / 2)
    halves = week.withColumn("_late", F.row_number().over(w.orderBy("week")) > mid)
    part = lambda late: F.avg(F.when(F.col("_late") == late, F.col("km")))
    sums = halves.groupBy(*keys).agg(
        F.count("*").alias("weeks"), F.sum("runs").alias("runs"), F.avg("km").alias("weekly_km"), F.max("longest").alias("longest_km"), F.avg("days").alias("days_a_week"), F.count_if(F.col("km") > 0).alias("active"),
        F.when(F.count("*") >= 4, F.coalesce((part(True) - part(False)) / F.when(part(False) > 0, part(False)), F.lit(0.0))).otherwise(0.0).alias("trend"), (F.sum("fast") / F.count("*")).alias("fast_a_week"),
    )
    return sums.withColumn("consistency", F.col("active") / (F.lit(float(weeks)) if weeks else F.col("weeks")))


def assessed(t: dict[str, Column], reference: tuple) -> dict[str, Column]:
    """Score (0 to 100, rounded), matched level and advice for one race, from the columns of ``training``."""
    _, _, volume, longest, days = reference
    parts = position(t["weekly_km"], volume, True) * 0.35 + position(t["longest_km"], longest, False) * 0.30 + position(t["days_a_week"], days, False) * 0.15 + t["consistency"] * 100 * 0.10
    score = clamp(parts + clamp(t["trend"] * 50, -15.0, 15.0) * 0.10 + 50 * 0.10, 0.0, 100.0)
    level = F.lit("Insufficient")
    for name, (a, _) in zip(LEVELS, volume, strict=True):
        level = F.when(t["weekly_km"] >= a, name).otherwise(level)
    rules = [
        (t["weekly_km"] < volume[0][0], "more_volume"), (t["longest_km"] < longest[0][0], "longer_run"), (t["days_a_week"] < days[0][0], "more_days"),
        (t["consistency"] < 0.7, "steadier_weeks"), (t["trend"] < -0.1, "volume_declines"), ((score >= 70) & (t["fast_a_week"] < 1.5), "more_quality"),
    ]
    advice = F.array_compact(F.array(*(F.when(held, code) for held, code in rules)))
    return {"score": half_up(score).cast("int"), "level": level, "advice": advice}


def race_readiness(runs: DataFrame, keys: list[str], as_of: str, weeks: int = 8) -> DataFrame:
    """For each athlete and race: score, level and advice, in order, from the last ``weeks`` weeks; athletes without runs then have score 0 and level ``No data``."""
    end = F.lit(as_of).cast("date")
    known = training(runs.where((F.col("day") >= F.date_sub(end, 7 * weeks)) & (F.col("day") <= end)), keys, weeks)
    every = runs.select(*keys).distinct().join(known, keys, "left")
    t = {c: F.col(c) for c in known.columns}
    told = F.array(*(F.struct(F.lit(r[0]).alias("race"), F.lit(r[1]).alias("km"), *(v.alias(k) for k, v in assessed(t, r).items())) for r in REFERENCES))
    out = every.select(*keys, F.col("weeks").isNull().alias("_none"), F.explode(told).alias("r"))
    return out.select(*keys, "r.race", "r.km", F.when(F.col("_none"), 0).otherwise(F.col("r.score")).alias("score"), F.when(F.col("_none"), "No data").otherwise(F.col("r.level")).alias("level"), F.when(F.col("_none"), F.array().cast("array<string>")).otherwise(F.col("r.advice")).alias("advice"))


def snapshots(runs: DataFrame, keys: list[str], granularity: str) -> DataFrame:
    """Each athlete's periods with runs: ``end``, the day of the last run in it, and ``n``, the runs in it."""
    return runs.groupBy(*keys, period_start(F.col("day"), granularity).alias("period")).agg(F.max("day").alias("end"), F.count("*").alias("n"))


def bests_at_end(runs: DataFrame, keys: list[str], granularity: str, n: int = 3) -> DataFrame:
    """``keys, period`` and ``bests_0`` to ``bests_6``, one of which is not null: the best ``n`` runs by pace of a race distance up to the end of a period with such runs."""
    km = F.col("distance") / 1000
    banded = within_bands(runs.where("moving_time > 0"), km, [(k, m) for k, m, _ in RACES])
    value = F.struct((F.col("moving_time") / km).alias("pace"), F.col("id"), km.alias("km"), F.col("moving_time").cast("double").alias("seconds"), F.col("target"))
    own = banded.select(*keys, "target", period_start(F.col("day"), granularity).alias("period"), value.alias("v"))
    state = as_of_best(own, [*keys, "target"], ["period", "v"], "v", n)
    at_end = state.groupBy(*keys, "target", "period").agg(F.max_by(F.array(*(f"best_{k}" for k in range(1, n + 1))), "v").alias("b"))  # the last row of the period is the largest
    return at_end.select(*keys, "period", *(F.when(F.col("target") == r[0], F.array_compact("b")).alias(f"bests_{k}") for k, r in enumerate(RACES)))


def vdot_at_end(runs: DataFrame, keys: list[str], granularity: str, n: int = 5) -> DataFrame:
    """``keys, period, vdot``: the mean of the best ``n`` scores up to the end of each period with runs that have one."""
    scored = runs.where("distance >= 3000 and moving_time > 0").withColumn("v", -vdot(F.col("distance"), F.col("moving_time"))).where("v < -10 and v > -100")
    state = as_of_best(scored.select(*keys, period_start(F.col("day"), granularity).alias("period"), "v", "id"), keys, ["period", "v", "id"], "v", n)
    best = [F.col(f"best_{k}") for k in range(1, n + 1)]
    mean = -sum((F.coalesce(x, F.lit(0.0)) for x in best), F.lit(0.0)) / sum((x.isNotNull().cast("int") for x in best), F.lit(0))
    return state.groupBy(*keys, "period").agg(F.max_by(mean, F.struct("v", "id")).alias("vdot"))


def as_of(parts: list[DataFrame], keys: list[str], carried: list[str]) -> DataFrame:
    """``parts``, which have other columns each, put together by ``keys, period``; columns ``carried`` keep the last value up to a period where it has none. One
    exchange and one sort: the parts are stacked, not joined."""
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    rest = [c for c in stacked.columns if c not in (*keys, "period")]
    one = stacked.repartition(*keys).groupBy(*keys, "period").agg(*(F.first(c, True).alias(c) for c in rest))
    w = Window.partitionBy(*keys).orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    return one.withColumns({c: F.last(c, True).over(w) for c in carried} | {"runs": F.sum("n").over(w)})


def recent_training(runs: DataFrame, keys: list[str], ends: DataFrame, weeks: int = 8) -> DataFrame:
    """``training`` of the ``weeks`` weeks before the end of each period. A run meets only the periods that end within the two
    stretches of that length next to it."""
    days = 7 * weeks
    number = lambda c: F.floor(F.unix_date(c) / days)
    near = runs.select(*keys, "day", "distance", "moving_time").withColumn("_bin", F.explode(F.array(number(F.col("day")), number(F.col("day")) + 1)))
    met = ends.select(*keys, "period", "end", number(F.col("end")).alias("_bin")).join(near, [*keys, "_bin"]).where((F.col("day") <= F.col("end")) & (F.col("day") >= F.date_sub("end", days)))
    return training(met, [*keys, "period"])


def curve(x: np.ndarray, y: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients m, a, b, c of seconds = a + b (ln km - m) + c (ln km - m)^2 by least squares for each column of ``x`` (ln km) and ``y`` (seconds) where ``held``,
    m being the mean of ln km; and for which columns there is one: not below three runs or without a solution."""

    def det(a, b, c, d, e, f, g, h, i):
        return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)

    def total(values: np.ndarray) -> np.ndarray:
        out = np.zeros(values.shape[1])
        for row in np.where(held, values, 0.0):  # one after the other, as a fold adds them
            out += row
        return out

    n = held.sum(axis=0).astype(float)
    with np.errstate(all="ignore"):
        m = total(x) / n
        x = x - m
        s1, s2, s3, s4 = (total(x**k) for k in (1.0, 2.0, 3.0, 4.0))
        t0, t1, t2 = total(y), total(y * x), total(y * x**2.0)
        whole = det(n, s1, s2, s1, s2, s3, s2, s3, s4)
        a, b, c = (top / whole for top in (det(t0, s1, s2, t1, s2, s3, t2, s3, s4), det(n, t0, s2, s1, t1, s3, s2, t2, s4), det(n, s1, t0, s1, s2, t1, s2, s3, t2)))
        return m, a, b, c, (n >= 3) & (np.abs(whole) > 1e-9)


def times_at(score: np.ndarray, metres: float) -> np.ndarray:
    """``scalars.vdot_time`` for an array of scores."""

    def miss(t: np.ndarray) -> np.ndarray:
        v = metres / t
        return (-4.60 + 0.182258 * v + 0.000104 * v * v) / (0.8 + 0.1894393 * np.exp(-0.012778 * t) + 0.2989558 * np.exp(-0.1932605 * t)) - score

    t = np.full(len(score), metres / 1000.0 * 4.5)
    with np.errstate(all="ignore"):
        for _ in range(NEWTON_STEPS):
            now = miss(t)
            slope = (miss(t + 0.001) - now) / 0.001
            t = np.where(np.abs(slope) < 1e-10, t, np.maximum(0.1, t - now / slope))
    return np.where(score > 0, t * 60.0, np.nan)


def blends(km: np.ndarray, seconds: np.ndarray, target: np.ndarray, held: np.ndarray, vdots: np.ndarray, scores: np.ndarray, mood: str, weights: dict[str, float]) -> np.ndarray:
    """The mean prediction for each state (row) and race of ``REFERENCES`` (column), nan without any. The best runs of a state are the entries of a column of
    ``km, seconds, target`` where ``held``; ``vdots`` has a score (or nan) and ``scores`` the readiness of each race for a state."""
    start, end = MOODS[mood]
    late = {k: p for k, _, p in RACES}
    states = np.arange(held.shape[1])
    out = np.full((len(states), len(REFERENCES)), np.nan)
    with np.errstate(all="ignore"):
        m, a, b, c, fits = curve(np.log(km), seconds, held)
        for nth, (_, goal, *_) in enumerate(REFERENCES):
            x = np.log(goal) - m
            parts = [
                (np.where(held & (np.abs(km - goal) >= 0.1), seconds * (goal / km) ** 1.06, np.nan), "riegel"), (np.where(fits, a + b * x + c * x * x, np.nan)[None], "curve"),
                (np.where(held & (target == goal), seconds, np.nan), "best"), (times_at(vdots, goal * 1000)[None], "vdot"),
            ]
            parts[2] = (np.sort(parts[2][0], axis=0)[: max(1, int((held & (target == goal)).sum(axis=0).max(initial=0)))], "best")
            parts.sort(key=lambda part: weights[part[1]])  # a stable sort by time then orders equal times by weight
            time = np.concatenate([t for t, _ in parts]).T
            weight = np.repeat([weights[source] for _, source in parts], [len(t) for t, _ in parts])
            time = np.where(time > 0, time, np.inf)
            order = np.argsort(time, axis=1, kind="stable")
            time, weight = np.take_along_axis(time, order, axis=1).T, weight[order].T
            n = np.isfinite(time).sum(axis=0)
            # the middle one made slower by what preparation lacks takes its place in the order
            middle = time[np.minimum(n // 2, len(time) - 1), states]
            ready = middle * (1 + (1 - scores[:, nth] / 100.0) * late[goal])
            place = ((time < ready) | ((time == ready) & (weight <= weights["readiness"]))).sum(axis=0)
            first, last = np.floor((n + 1) * start), np.ceil((n + 1) * end)
            top, bottom = np.zeros(len(states)), np.zeros(len(states))
            for k in range(len(time) + 1):
                kept, own, before = (k >= first) & (k < last), min(k, len(time) - 1), max(k - 1, 0)
                t = np.where(k < place, time[own], np.where(k == place, ready, time[before]))
                w = np.where(k < place, weight[own], np.where(k == place, weights["readiness"], weight[before]))
                top += np.where(kept, t * w, 0.0)
                bottom += np.where(kept, w, 0.0)
            out[:, nth] = np.where((n > 0) & (bottom != 0), top / bottom, np.nan)
    return out


def with_blends(state: DataFrame, kept: list[str], scores: list[Column], mood: str, weights: dict[str, float]) -> DataFrame:
    """The columns ``kept`` of ``state`` and ``blends``: the mean prediction for each race of ``REFERENCES`` from ``bests, vdot`` and the races' ``scores``. Worked out in
    numpy for a batch of states at a time."""
    races = range(len(scores))
    lists = [F.coalesce(F.col(f"bests.{c}"), F.array().cast("array<double>")).alias(f"_{c}") for c in ("km", "seconds", "target")]
    wide = state.select(*kept, *lists, F.col("vdot").alias("_vdot"), *(s.cast("double").alias(f"_score_{k}") for k, s in enumerate(scores)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = dict(zip(batch.schema.names, batch.columns, strict=True))
            size = np.diff(of["_km"].offsets.to_numpy())
            column = np.repeat(np.arange(len(size)), size)
            place = np.arange(len(column)) - np.repeat(np.cumsum(size) - size, size)
            held = np.zeros((max(1, int(size.max(initial=0))), len(size)), bool)
            held[place, column] = True
            dense = []
            for name, fill in (("_km", 1.0), ("_seconds", 0.0), ("_target", 0.0)):
                table = np.full(held.shape, fill)
                table[place, column] = of[name].flatten().to_numpy()
                dense.append(table)
            told = blends(*dense, held, of["_vdot"].to_numpy(zero_copy_only=False), np.stack([of[f"_score_{k}"].to_numpy(zero_copy_only=False) for k in races], axis=1), mood, weights)
            values = pa.array(told.reshape(-1), from_pandas=True)
            yield pa.RecordBatch.from_arrays([*(of[c] for c in kept), pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * told.shape[1]), values)], [*kept, "blends"])

    return wide.mapInArrow(run, StructType([*(state.schema[c] for c in kept), StructField("blends", ArrayType(DoubleType()))]))


def prediction_history(runs: DataFrame, keys: list[str], granularity: str = "month", mood: str = "realistic", weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """For each period with runs (two runs at least so far) and race distance the seconds predicted from the runs up to its end.

    Riegel's formula from the three best runs of each distance, a quadratic curve through them, the best runs of the
    distance itself, VDOT, and the middle of these made slower by lacking preparation in the last eight weeks; ordered by
    time, the ends of the order cut off by ``mood``, and averaged by weight. ``predicted`` is then the mean of a period and
    its neighbours, ``low`` and ``high`` lie 5 percent around it. ``runs`` has ``keys, id, day, distance, moving_time``.
    """
    ends = snapshots(runs, keys, granularity)
    own = [*keys, "period"]
    trained = recent_training(runs, keys, ends).drop("runs")
    bests = [f"bests_{k}" for k in range(len(RACES))]
    state = as_of([ends, bests_at_end(runs, keys, granularity), vdot_at_end(runs, keys, granularity), trained], keys, [*bests, "vdot"]).where("runs >= 2")
    state = state.withColumn("bests", F.flatten(F.array_compact(F.array(*bests))))
    t = {c: F.col(c) for c in trained.columns}
    scores = {r[1]: F.coalesce(assessed(t, r)["score"], F.lit(0)) for r in REFERENCES}
    told = with_blends(state, [*own, "end", "runs"], list(scores.values()), mood, weights)
    # a row for each period until its neighbours are known, then one for each race
    w, none = Window.partitionBy(*keys).orderBy("period"), F.array().cast("array<double>")
    near = told.select(*own, "end", "runs", F.col("blends").alias("blend"), F.coalesce(F.lag("blends").over(w), none).alias("before"), F.coalesce(F.lead("blends").over(w), none).alias("after"))
    raced = near.select(*own, "end", "runs", F.inline(F.arrays_zip(F.array(*map(F.lit, scores)).alias("km"), "blend", "before", "after")))
    three = [F.col(c) for c in ("before", "blend", "after")]
    predicted = sum((F.coalesce(x, F.lit(0.0)) for x in three), F.lit(0.0)) / F.nullif(sum((x.isNotNull().cast("int") for x in three), F.lit(0)), F.lit(0))
    out = raced.select(*own, "end", "runs", "km", "blend", predicted.alias("predicted"))
    return out.withColumns({"low": F.col("predicted") * 0.95, "high": F.col("predicted") * 1.05})
