"""Workout classes by additive rules: a table of rules turned into one sum per class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline.functions.scalars import half_up

# Each group is read from the top and its first rule that holds adds its points to the classes.
Group = list[tuple[str, dict[str, int]]]
BIKE: list[Group] = [
    [("sport_type = 'MountainBike'", {"Mountain Bike": 500})],
    [("name rlike '(?i)mountain|mtb|trail'", {"Mountain Bike": 100})],
    [("name rlike '(?i)road|cycling|bike'", {"Road Bike": 100})],
    [
        ("climb_per_km > 50", {"Mountain Bike": 200}), ("climb_per_km > 20", {"Mountain Bike": 100, "Road Bike": -50}), ("climb_per_km > 10", {"Mountain Bike": 50, "Road Bike": -20}),
        ("true", {"Road Bike": 50, "Mountain Bike": -50}),
    ],
    [("speed_kmh > 30", {"Road Bike": 100, "Mountain Bike": -50}), ("speed_kmh > 20", {"Road Bike": 50}), ("speed_kmh < 15", {"Mountain Bike": 50, "Road Bike": -50})],
    [("speed_cv > 30", {"Mountain Bike": 100}), ("speed_cv > 20", {"Mountain Bike": 50}), ("true", {"Road Bike": 50})],
    [("moving_ratio < 0.8", {"Mountain Bike": 50})],
    [("effort > 0.6", {"Mountain Bike": 50})],
    [("zone_high > 40", {"Mountain Bike": 50}), ("zone_low > 60", {"Road Bike": 50})],
]
TEMPO, SPEED, LONG, EASY, RACE, TRAIL = "Tempo Run", "Speed Work", "Long Run", "Easy/Recovery Run", "Race", "Trail/Hills"
RUN: list[Group] = [
    [("sport_type = 'TrailRun'", {TRAIL: 220})],
    [("workout_type = 1", {RACE: 280})],
    [("name rlike '(?i)tempo|threshold|umbral'", {TEMPO: 180})],
    [("name rlike '(?i)fartlek|interval|series|repeats?|vo2|max'", {SPEED: 190})],
    [("name rlike '(?i)long run|tirada|fondo'", {LONG: 160})],
    [("name rlike '(?i)recovery|easy|suave|regenerativo'", {EASY: 170})],
    [("name rlike '(?i)race|carrera|competition|test'", {RACE: 220})],
    [
        ("km >= 24 or minutes >= 140", {LONG: 210, EASY: -10}), ("km >= 16 or minutes >= 95", {LONG: 160, TEMPO: 25}), ("km >= 10 or minutes >= 60", {LONG: 70, TEMPO: 45}),
        ("km <= 4 and minutes <= 30", {EASY: 60, SPEED: 30}),
    ],
    [("climb_per_km > 45", {TRAIL: 190, SPEED: 20, RACE: -20}), ("climb_per_km > 25", {TRAIL: 130, TEMPO: -10}), ("climb_per_km > 12", {TRAIL: 60}), ("true", {TRAIL: -15})],
    [("moving_ratio < 0.7", {TRAIL: 35, SPEED: 20, RACE: -20}), ("moving_ratio > 0.95", {TEMPO: 35, RACE: 20})],
    [
        ("effort >= 0.82", {SPEED: 120, RACE: 90, TEMPO: 40, EASY: -70}), ("effort >= 0.62", {TEMPO: 100, SPEED: 55, RACE: 25, LONG: 20}), ("effort >= 0.35", {EASY: 35, LONG: 25, TEMPO: 15}),
        ("true", {EASY: 130, RACE: -40, SPEED: -40}),
    ],
    [("pace_cv > 20", {SPEED: 155, TEMPO: -20}), ("pace_cv > 12", {SPEED: 70, TEMPO: 35}), ("pace_cv < 7 and km >= 6", {TEMPO: 100, RACE: 35, EASY: -20})],
    [("pace > 0 and pace <= 4.1 and km >= 5", {RACE: 70, TEMPO: 60, SPEED: 20}), ("pace > 0 and pace <= 4.45 and km >= 6", {TEMPO: 55, RACE: 20}), ("pace >= 5.7 and effort < 0.5", {EASY: 55})],
    [("has_zones and zone_low >= 70", {EASY: 120, LONG: 30, SPEED: -50, RACE: -45})],
    [("has_zones and zone_midhigh >= 33", {TEMPO: 110, SPEED: 40, EASY: -25})],
    [("has_zones and zone_high >= 20", {SPEED: 120, RACE: 80, TEMPO: 30, EASY: -60})],
    [("has_zones and zone_high < 8 and zone_low > 65", {EASY: 55, RACE: -20, SPEED: -20})],
    [("has_hr and hr_cv > 10", {SPEED: 35})],
    [("has_hr and hr_cv < 5 and km >= 8", {TEMPO: 25, LONG: 10})],
    [("km >= 8 and second_half < 0.97", {TEMPO: 60, RACE: 30, LONG: 20}), ("km >= 8 and second_half > 1.08", {EASY: 25, RACE: -20, TEMPO: -15})],
]

FEATURES = {
    "name": "string", "sport_type": "string", "workout_type": "int", "climb_per_km": "double", "speed_kmh": "double", "speed_cv": "double", "moving_ratio": "double", "effort": "double", "zone_low": "double",
    "zone_midhigh": "double", "zone_high": "double", "km": "double", "minutes": "double", "pace": "double", "pace_cv": "double", "hr_cv": "double", "second_half": "double", "has_zones": "boolean", "has_hr": "boolean",
}
#: What a missing measure counts as; names, kinds of workout and the ratio of the halves stay missing.
MISSING = {c: 0.0 for c, t in FEATURES.items() if t == "double" and c != "second_half"} | {"has_zones": False, "has_hr": False}


def features(df: DataFrame) -> DataFrame:
    """Features that an activity's own columns give; those of its samples are joined by the caller. A missing measure counts as zero, as the rules expect."""
    km, minutes = F.coalesce(F.col("distance"), F.lit(0.0)) / 1000.0, F.coalesce(F.col("moving_time"), F.lit(0)) / 60.0
    elapsed = F.coalesce(F.nullif(F.col("elapsed_time"), F.lit(0)), F.nullif(F.col("moving_time"), F.lit(0)), F.lit(1))
    known = {
        "km": km, "minutes": minutes, "pace": minutes / F.nullif(km, F.lit(0.0)), "speed_kmh": km / F.nullif(minutes / 60.0, F.lit(0.0)),
        "moving_ratio": F.least(F.lit(1.0), F.coalesce(F.col("moving_time"), F.lit(0)) / elapsed), "effort": F.least(F.greatest(F.coalesce(F.col("suffer_score"), F.lit(0.0)), F.lit(0.0)), F.lit(300.0)) / 300.0,
    }
    out = df.withColumns({k: v for k, v in known.items() if k not in df.columns})
    if "climb_per_km" not in out.columns and "total_elevation_gain" in out.columns:
        out = out.withColumn("climb_per_km", F.col("total_elevation_gain") / F.nullif(F.col("km"), F.lit(0.0)))
    out = out.withColumns({c: F.lit(None).cast(t) for c, t in FEATURES.items() if c not in out.columns})
    return out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in MISSING.items()})


def points_of(rules: list[Group], name: str) -> Column:
    """The class's sum over all groups; a condition on a missing feature doesn't hold."""
    total = F.lit(0)
    for group in rules:
        chosen = None
        for condition, points in group:
            holds = F.coalesce(F.expr(condition), F.lit(False))
            chosen = F.when(holds, points.get(name, 0)) if chosen is None else chosen.when(holds, points.get(name, 0))
        total = total + chosen.otherwise(0)
    return total


def scored(df: DataFrame, rules: list[Group]) -> DataFrame:
    """Adds ``classes``: array of class, points and share among the positive classes in percent, best first, ties by name."""
    names = sorted({c for group in rules for _, points in group for c in points})
    every = F.array(*[F.struct((-points_of(rules, n)).alias("minus"), F.lit(n).alias("class")) for n in names])
    best = F.filter(F.array_sort(every), lambda s: s["minus"] < 0)
    total = F.aggregate(best, F.lit(0), lambda a, s: a - s["minus"])
    return df.withColumn("classes", F.transform(best, lambda s: F.struct(s["class"].alias("class"), (-s["minus"]).alias("points"), (F.floor(-s["minus"] * 1000.0 / total + 0.5) / 10).alias("share"))))


def with_confidence(classified: DataFrame, fallback: Column | None = None) -> DataFrame:
    """``scored`` with ``classes`` never empty, where ``fallback`` names the class of an activity without points, and ``confidence``: score, level, how many
    percent of the features are there, the lead of the first class in percent, and what is missing.

    The score is 0.2 + 0.4 lead + 0.3 coverage + 0.1 share of the first class among the best five, from 0.05 to 0.99.
    """
    kind = "array<struct<class: string, points: int, share: double>>"
    own = F.col("classes").cast(kind)
    if fallback is not None:
        own = F.when(F.size(own) == 0, F.array(F.struct(fallback.alias("class"), F.lit(100).alias("points"), F.lit(100.0).alias("share"))).cast(kind)).otherwise(own)
    out = classified.withColumn("classes", own)
    top = F.slice("classes", 1, 5)
    points = lambda k: F.coalesce(F.get(top, F.lit(k))["points"], F.lit(0))
    total = F.aggregate(top, F.lit(0.0), lambda a, c: a + c["points"])
    lead, share = F.when(points(0) > 0, (points(0) - points(1)) / points(0)).otherwise(0.0), points(0) / F.when(total == 0, 1.0).otherwise(total)
    there = {
        "distance": F.col("km") > 0, "moving time": F.col("minutes") > 0, "elevation": F.lit(True), "pace": F.col("pace") > 0, "pace stream": F.coalesce(F.col("has_pace"), F.lit(False)), "effort": F.col("effort") > 0,
        "heartrate": F.coalesce(F.col("average_heartrate") > 0, F.lit(False)), "heartrate stream": F.col("has_hr"), "training zones": F.col("has_zones"), "negative split": F.col("second_half").isNotNull(),
    }
    coverage = sum((v.cast("int") for k, v in there.items() if k != "distance"), there["distance"].cast("int")) / float(len(there))
    score = F.least(F.greatest(0.2 + lead * 0.4 + coverage * 0.3 + share * 0.1, F.lit(0.05)), F.lit(0.99))
    missing = F.array_compact(F.array(*(F.when(~there[k], k) for k in ("heartrate stream", "training zones", "pace stream", "negative split"))))
    level = F.when(score >= 0.75, "high").when(score >= 0.55, "medium").otherwise("low")
    return out.withColumn("confidence", F.struct(half_up(score, 2).alias("score"), level.alias("level"), half_up(coverage * 100).cast("int").alias("coverage"), half_up(lead * 100).cast("int").alias("margin"), missing.alias("missing")))


#: Which zones, from 0, make up the low, middle and high ones, by the number of zones.
BUCKETS = {1: {"midlow": (0,)}, 2: {"low": (0,), "high": (1,)}, 3: {"low": (0,), "midlow": (1,), "high": (2,)}, 4: {"low": (0,), "midlow": (1,), "midhigh": (2,), "high": (3,)}}


def stream_features(points: DataFrame, zones: list[tuple[float, float]] = ()) -> DataFrame:
    """Features of an activity's samples: coefficients of variation (population, percent) of pace, speed and heart rate, how long the second
    half of the way takes against the first, and the shares of time in low, middle and high heart-rate zones.

    ``points`` has ``activity_id, idx, km`` (from the start), ``d_time`` (seconds from the sample before) and ``heart_rate``. Steps without distance or
    time don't count, nor paces outside 2 to 20 minutes a kilometre. ``zones`` are (from, to) in order, the last one open. A variation needs two
    values, that of heart rate more than ten samples; the streams count as there from 30 values on.
    """
    w, n = Window.partitionBy("activity_id").orderBy("idx"), len(zones)
    step = F.col("km") - F.lag("km").over(w)
    moved = (step > 0) & (F.col("d_time") > 0)
    pace = F.when(moved, F.col("d_time") / 60.0 / step)
    hr = F.when(F.col("heart_rate") > 0, F.col("heart_rate"))
    zone = F.when(hr >= zones[-1][0], n - 1) if n else F.lit(None).cast("int")
    for k, (low, high) in reversed(list(enumerate(zones))):
        zone = F.when((hr >= low) & ((F.lit(high) == -1) | (hr < high)), k).otherwise(zone)
    at = points.withColumns({
        "_pace": F.when((pace >= 2) & (pace <= 20), pace), "_speed": F.when(moved, step / F.col("d_time") * 3600), "_t": F.sum("d_time").over(w.rowsBetween(Window.unboundedPreceding, 0)), "_late": half_up(F.col("km"), 9) >= half_up(F.max("km").over(Window.partitionBy("activity_id")) / 2, 9),
        "_first": F.lag("idx").over(w).isNull(), "_hr": hr, "_zone": F.when(F.col("d_time") > 0, zone),
    })
    cv = lambda c: F.when(F.count(c) >= 2, F.stddev_pop(c) / F.nullif(F.avg(c), F.lit(0.0)) * 100).otherwise(0.0)
    half, past = F.min(F.when(F.col("_late") & ~F.col("_first"), F.col("_t"))), F.count(F.when(F.col("_late") & F.col("_first"), 1)) > 0  # past: the first sample lies beyond the middle
    spent = lambda which: F.coalesce(F.sum(F.when(F.col("_zone").isin(*which), F.col("d_time"))) * 100.0 / F.nullif(F.sum(F.when(F.col("_zone").isNotNull(), F.col("d_time"))), F.lit(0)), F.lit(0.0))
    places = BUCKETS.get(n, {"low": (0, 1), "midlow": (2,), "midhigh": (3,), "high": tuple(range(4, n))} if n else {})
    shares = [(spent(places[k]) if k in places else F.lit(0.0)).alias(f"zone_{k}") for k in ("low", "midlow", "midhigh", "high")]
    out = at.groupBy("activity_id").agg(
        cv("_pace").alias("pace_cv"), cv("_speed").alias("speed_cv"), F.when(F.count("*") > 10, cv("_hr")).otherwise(0.0).alias("hr_cv"), (F.count("heart_rate") >= 30).alias("has_hr"), (F.count("_pace") >= 30).alias("has_pace"),
        F.when(~past, half).alias("_half"), F.sum("d_time").alias("_all"), *shares,
    )
    second = F.when((F.col("_half") > 0) & (F.col("_all") > F.col("_half")), (F.col("_all") - F.col("_half")) / F.col("_half"))
    return out.withColumns({"second_half": second, "has_zones": F.col("has_hr") & F.lit(n >= 3)}).drop("_half", "_all")


def classified(activities: DataFrame, samples: DataFrame, rules: list[Group], zones: list[tuple[float, float]] = ()) -> DataFrame:
    """Activities (``id`` and their columns) with their classes and confidence, features of their samples joined by id. A run without any points is a long
    one from 12 km on, else an easy one."""
    known = activities.join(stream_features(samples, zones).withColumnRenamed("activity_id", "id"), "id", "left")
    return with_confidence(scored(features(known), rules), F.when(F.coalesce(F.col("distance"), F.lit(0.0)) >= 12000, LONG).otherwise(EASY) if rules is RUN else None)
