"""Analyses of whole activities: what every sample needs is worked out once, what each sport wants is summed up at once.

All windows go over an activity's samples in order, so any choice of analyses costs one exchange by activity and one sort.
Runs of samples (climbs, stops, technical zones) are closed by the row that ends them and collected with the sums.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline.functions.scalars import half_up, ratio
from paceline.operators.analysers import drag_power, grade_adjusted_pace, wind_adjusted_pace, wind_component
from paceline.operators.points import deltas, positive, prefix_sums, so_far, track, with_fatigue

FTP = 250.0
Metrics = dict[str, Column]


def before():
    return track().rowsBetween(Window.unboundedPreceding, -1)


def kind(sport: Column) -> Column:
    """The analysis of a sport, by what its name holds."""
    s = F.lower(F.coalesce(sport, F.lit("")))
    rough = s.contains("gravel") | s.contains("mtb") | s.contains("mountainbike")
    return F.when(s.contains("run"), F.when(s.contains("trail"), "trail").otherwise("running")).when(s.contains("ride") | s.contains("bike") | s.contains("mtb"), F.when(rough, "gravel").otherwise("cycling")).when(s.contains("hike"), "hiking").otherwise("base")


def with_runs(df: DataFrame, name: str, inside: Column, start: Metrics, end: Metrics, peak: Column | None = None, open_end: bool = True) -> DataFrame:
    """Adds ``name``: on the last row of each run of rows that are ``inside`` a struct of ``start`` (taken on its first row), ``end`` (on its last) and
    ``peak`` (the largest in it). A run still open at the end of the activity counts unless ``open_end`` is false."""
    on, first, most = f"_{name}_on", f"_{name}_first", f"_{name}_most"
    df = df.withColumn(on, F.coalesce(inside, F.lit(False)))
    begins = F.col(on) & ~F.coalesce(F.lag(on).over(track()), F.lit(False))
    df = df.withColumn(first, F.last(F.when(begins, F.struct(F.col("idx").alias("_at"), *(v.alias(k) for k, v in start.items()))), True).over(so_far()))
    parts = [F.col(f"{first}.{k}").alias(k) for k in start] + [v.alias(k) for k, v in end.items()]
    if peak is not None:
        df = df.withColumn(most, F.max(F.when(F.col(on), F.struct(f"{first}._at", peak.alias("v")))).over(so_far()))
        parts.append(F.col(f"{most}.v").alias("peak"))
    closes = F.col(on) & ~F.coalesce(F.lead(on).over(track()), F.lit(not open_end))
    return df.withColumn(name, F.when(closes, F.struct(*parts)))


def collected(name: str) -> Column:
    """The closed runs of an activity in order."""
    return F.array_sort(F.collect_list(name))


def facts(points: DataFrame) -> DataFrame:
    """Samples with what all analyses read. Nulls of a measure leave that measure out."""
    own = deltas(points)
    lag = lambda c: F.lag(c).over(track())
    turn = F.when((F.col("bearing") != 0) & (lag("bearing") != 0), F.abs(F.col("bearing") - lag("bearing")))
    own = own.withColumns({
        "later": lag("idx").isNotNull(), "turn": turn, "rise": F.col("elevation") - lag("elevation"), "n": F.count("*").over(Window.partitionBy("activity_id")), "second": F.unix_timestamp("ts") - F.unix_timestamp(F.first("ts").over(so_far())),
        "going": F.coalesce(F.col("moving") & (F.col("speed") > 0), F.lit(False)), "np4": F.pow(F.avg(positive("power")).over(track().rowsBetween(0, 29)), F.lit(4.0)),
    })
    at, up = {"start_idx": F.col("idx"), "start_km": F.col("km")}, F.greatest("climb", F.lit(0.0))
    ends = {"end_idx": F.col("idx"), "end_km": F.col("km")}
    own = with_runs(own, "climb_run", (F.col("grade") >= 3) & F.col("moving"), at | {"gain0": F.col("gain") - up, "second0": F.col("second")}, ends | {"gain1": F.col("gain"), "second1": F.col("second")}, F.col("grade"))
    own = with_runs(own, "stop_run", (F.col("speed") < 0.5) & ~F.col("moving"), at | {"second0": F.col("second") - F.col("d_time")}, ends | {"second1": F.col("second")})
    own = with_runs(own, "descent_run", F.col("grade") < -2, at, ends, open_end=False)
    rough = (F.abs("grade") > 8) | F.coalesce(F.abs("rise") > 2, F.lit(False))
    return with_runs(own, "zone_run", rough & ~F.col("moving"), at, {"end_idx": F.col("idx") + 1, "end_km": F.col("km")}, open_end=False)


def with_wind(samples: DataFrame, speed: Column, direction: Column, cda: float = 0.3) -> DataFrame:
    """``facts`` with the wind's part along the way (positive from ahead) of moving samples, and stretches of more than 5 km/h of it."""
    on = F.col("going")
    out = samples.withColumn("wind", F.when(on, wind_component(F.coalesce("bearing", F.lit(0.0)), F.coalesce(direction, F.lit(0.0)), F.coalesce(speed, F.lit(0.0)))))
    out = out.withColumns({"place": F.count(F.when(on, 1)).over(so_far()) - 1, "wall": F.when(on, F.abs("wind") > 5), "drag": drag_power(F.col("speed"), F.col("wind"), cda), "wap": wind_adjusted_pace(F.col("speed"), F.col("wind"))})
    out = out.withColumn("was_wall", F.coalesce(F.last("wall", True).over(before()), F.lit(False)))
    out = out.withColumn("wall_start", F.last(F.when(F.col("wall") & ~F.col("was_wall"), F.col("place")), True).over(so_far()))
    out = out.withColumn("wall_most", F.max(F.when(F.col("wall"), F.struct("wall_start", F.abs("wind").alias("v")))).over(before()))
    return out.withColumn("wall_run", F.when(~F.col("wall") & F.col("was_wall"), F.struct(F.col("wall_start").alias("start_idx"), F.col("place").alias("end_idx"), F.col("wall_most.v").alias("severity"))))


def climbs_of(runs: Column, min_km: float = 0.3, min_gain: float = 20.0, min_grade: float = 3.0, merge_km: float = 0.05) -> Column:
    """Runs that are long, high and steep enough, near neighbours merged; with mean grade and metres an hour."""
    climb = F.transform(runs, lambda r: F.struct(
        r["start_idx"].alias("start_idx"), r["end_idx"].alias("end_idx"), r["start_km"].alias("start_km"), r["end_km"].alias("end_km"), (r["end_km"] - r["start_km"]).alias("km"),
        half_up(r["gain1"] - r["gain0"], 6).alias("gain"), (r["second1"] - r["second0"]).alias("seconds"), r["peak"].alias("max_grade"),
    ))
    fine = F.filter(climb, lambda c: (half_up(c["km"], 6) >= min_km) & (c["gain"] >= min_gain) & (c["gain"] / (c["km"] * 1000) * 100 >= min_grade))

    def add(found: Column, c: Column) -> Column:
        last = F.try_element_at(found, F.lit(-1))
        near = F.coalesce(half_up(c["start_km"] - last["end_km"], 6) <= merge_km, F.lit(False))
        both = F.struct(
            last["start_idx"].alias("start_idx"), c["end_idx"].alias("end_idx"), last["start_km"].alias("start_km"), c["end_km"].alias("end_km"), (last["km"] + c["km"]).alias("km"), (last["gain"] + c["gain"]).alias("gain"),
            (last["seconds"] + c["seconds"]).alias("seconds"), F.greatest(last["max_grade"], c["max_grade"]).alias("max_grade"),
        )
        return F.when(near, F.concat(F.slice(found, 1, F.size(found) - 1), F.array(both))).otherwise(F.concat(found, F.array(c)))

    kind_of = "array<struct<start_idx: int, end_idx: int, start_km: double, end_km: double, km: double, gain: double, seconds: bigint, max_grade: double>>"
    merged = F.aggregate(fine.cast(kind_of), F.array().cast(kind_of), lambda a, c: add(a, c).cast(kind_of))
    return F.transform(merged, lambda c: F.struct(c["start_idx"].alias("start_idx"), c["end_idx"].alias("end_idx"), c["km"].alias("km"), c["gain"].alias("gain"), c["seconds"].alias("seconds"), c["max_grade"].alias("max_grade"), (c["gain"] / (c["km"] * 1000) * 100).alias("grade"), F.when(c["seconds"] > 0, c["gain"] / c["seconds"] * 3600).alias("vam")))


def base() -> Metrics:
    hr, watts, speed = positive("heart_rate"), positive("power"), F.when(F.col("going"), F.col("speed"))
    quarter = F.floor(F.col("n") / 4)
    first, last = F.avg(F.when(F.col("idx") < quarter, F.col("heart_rate"))), F.avg(F.when(F.col("idx") >= F.col("n") - quarter, F.col("heart_rate")))
    return {
        "samples": F.count("*"), "km": F.max("km"), "seconds": F.max("second"), "moving_seconds": F.sum(F.when(F.col("moving"), F.col("d_time")).otherwise(0)), "gain": F.max("gain"), "loss": F.max("loss"), "highest": F.max("elevation"), "lowest": F.min("elevation"),
        "speed": F.coalesce(F.avg(speed), F.lit(0.0)), "top_speed": F.coalesce(F.max(speed), F.lit(0.0)), "hr": F.avg(hr), "hr_max": F.max(hr), "hr_drift": (last - first) / F.nullif(first, F.lit(0.0)) * 100, "watts": F.avg(watts), "watts_max": F.max(watts), "cadence": F.avg(positive("cadence")),
        "climb_runs": collected("climb_run"), "stop_runs": collected("stop_run"),
    }


def running() -> Metrics:
    return {"pace": F.avg(F.when(F.col("going"), 60 / F.col("speed"))), "cadences": F.array_sort(F.collect_list(positive("cadence")))}


def trail() -> Metrics:
    fast = F.when((F.col("grade") < -2) & F.col("going"), F.col("speed"))
    return running() | {
        "gap": F.avg(F.when(F.col("going"), grade_adjusted_pace(F.col("speed"), F.col("grade")))), "descents": F.count("descent_run"), "technical_samples": F.count_if(F.abs("grade") > 8), "moving_samples": F.count_if("moving"),
        "descent_speed": F.avg(fast), "descent_top": F.max(fast), "zones": collected("zone_run"),
    }


def cycling() -> Metrics:
    by_terrain = lambda held: F.avg(F.when(F.col("going") & held, F.col("speed")))
    np4 = F.avg(F.when(F.col("idx") < F.col("n") - 30, F.col("np4")))
    return {"np": F.coalesce(F.pow(np4, F.lit(0.25)), F.avg(positive("power"))), "climb_speed": by_terrain(F.col("grade") > 2), "flat_speed": by_terrain(F.abs("grade") <= 2), "downhill_speed": by_terrain(F.col("grade") < -2)}


def gravel() -> Metrics:
    steps = F.col("later")
    points = F.when(F.col("turn") > 30, 2).otherwise(0) + F.when(F.abs("grade") > 10, 1).otherwise(0) + F.when(F.abs("rise") > 2, 1).otherwise(0)
    slower, faster = steps & (F.col("acceleration") < -0.5), steps & (F.col("acceleration") > 0.5)
    return cycling() | {
        "speed_variation": F.coalesce(F.avg(F.when(steps, F.abs("d_speed"))), F.lit(0.0)), "rise_variation": F.coalesce(F.avg(F.when(steps, F.abs("rise"))), F.lit(0.0)), "technical_points": F.sum(F.when(steps, points).otherwise(0)),
        "brakings": F.count_if(slower), "braking": F.coalesce(F.avg(F.when(slower, -F.col("acceleration"))), F.lit(0.0)), "bursts": F.count_if(faster), "burst": F.coalesce(F.avg(F.when(faster, F.col("acceleration"))), F.lit(0.0)),
    }


def hiking() -> Metrics:
    up, down = (F.col("grade") > 2) & F.col("moving"), (F.col("grade") < -1) & F.col("moving")
    last = lambda held, c: F.max_by(c, F.when(held, F.col("idx"))) - F.min_by(c, F.when(held, F.col("idx")))
    speed = lambda held, f: f(F.when(held & (F.col("speed") > 0), F.col("speed")))
    return {
        "steepest": F.max("grade"), "steepness": F.max(F.abs("grade")), "up_seconds": F.sum(F.when(up, F.col("d_time"))), "up_km": last(up, "km"), "up_gain": last(up, "gain"), "up_speed": speed(up, F.avg),
        "down_seconds": F.sum(F.when(down, F.col("d_time"))), "down_speed": speed(down, F.avg), "down_top": speed(down, F.max),
    }


def aero() -> Metrics:
    most = F.max_by(F.struct(F.col("place").alias("idx"), "wind", "wap"), F.when(F.col("wind").isNotNull(), F.struct(half_up(F.abs("wind"), 9), -F.col("place"))))
    return {
        "headwind_penalty": half_up(F.coalesce(F.sum(F.when(F.col("wind") > 2, F.col("wind") * F.col("speed"))), F.lit(0.0))), "tailwind_bonus": half_up(F.coalesce(F.sum(F.when(F.col("wind") < -1, F.abs(F.col("wind") * F.col("speed")))), F.lit(0.0))),
        "drag": half_up(F.coalesce(F.avg(F.when(F.col("drag") > 0, F.col("drag"))), F.lit(0.0))), "windiest": most, "walls": collected("wall_run"), "wind_samples": F.count("wind"),
    }


def told(m: Callable[[str], Column], of: str) -> Metrics:
    """The results of one analysis from its sums, ``m`` giving a sum by name. ``per_km`` divides by the distance, by 1 if there is none."""
    whole = F.when(m("km") > 0, m("km")).otherwise(1.0)
    stage = lambda x, names: F.when(x > names[0][0], names[0][1]).when(x > names[1][0], names[1][1]).when(x > names[2][0], names[2][1]).otherwise(names[3])
    if of == "running":
        session = F.when(ratio(m("gain"), m("km")) > 0.05, "hill workout").when(m("km") > 20, "long run").when(m("hr_drift") > 5, "tempo run").otherwise("easy run")
        c, size = m("cadences"), F.size(m("cadences"))
        low, high = F.get(c, F.floor(size * 0.25).cast("int")), F.get(c, F.floor(size * 0.75).cast("int"))
        steady = F.when(size >= 2, F.size(F.filter(c, lambda x: (x >= low) & (x <= high))) * 100.0 / size)
        return {"pace": m("pace"), "session": session, "cadence_stability": half_up(steady).cast("int"), "cadence_consistency": F.when(steady > 80, "high").when(steady > 60, "moderate").when(size >= 2, "low")}
    if of == "trail":
        score, efficiency = ratio(m("technical_samples").cast("double"), m("moving_samples").cast("double")) * 100, m("descent_speed") / F.when(m("speed") > 0, m("speed")).otherwise(1.0)
        return told(m, "running") | {
            "gap": m("gap"), "descents": m("descents"), "climbs_a_km": F.size(m("climbs")) / whole, "technical_score": half_up(score).cast("int"), "terrain": F.when(score > 15, "technical").when(score > 5, "moderate").otherwise("easy"),
            "descent_speed": half_up(m("descent_speed"), 1), "descent_top": half_up(m("descent_top"), 1), "descent_efficiency": half_up(efficiency * 100).cast("int"),
            "descent_quality": F.when(efficiency > 1.5, "excellent").when(efficiency > 1.2, "good").when(efficiency.isNotNull(), "moderate"), "zones": m("zones"),
        }
    if of == "cycling":
        intensity = m("np") / FTP
        level = F.when(intensity < 0.75, "endurance").when(intensity < 0.85, "steady").when(intensity < 1.05, "tempo").when(intensity < 1.2, "threshold").when(intensity.isNotNull(), "vo2max")
        vams = F.filter(F.transform(m("climbs"), lambda c: c["vam"]), lambda v: v > 0)
        return {
            "np": m("np"), "intensity": half_up(intensity, 2), "tss": half_up(m("moving_seconds") / 3600 * m("np") * intensity / FTP * 100).cast("int"), "effort": level, "climb_speed": half_up(m("climb_speed"), 1), "flat_speed": half_up(m("flat_speed"), 1),
            "downhill_speed": half_up(m("downhill_speed"), 1), "best_vam": half_up(F.array_max(vams)).cast("int"),
        }
    if of == "gravel":
        rough, technical = m("speed_variation") * 10 + m("rise_variation") * 5, m("technical_points") / m("samples") * 100
        return told(m, "cycling") | {
            "roughness": half_up(rough).cast("int"), "speed_variation": half_up(m("speed_variation"), 1), "rise_variation": half_up(m("rise_variation"), 2), "surface": stage(rough, [(50, "very_rough"), (30, "rough"), (15, "moderate"), "smooth"]),
            "technical_score": half_up(technical).cast("int"), "difficulty": stage(technical, [(30, "extreme"), (20, "very_technical"), (10, "technical"), "easy"]), "brakings": m("brakings"), "braking": m("braking"), "brakings_a_km": m("brakings") / whole,
            "bursts": m("bursts"), "burst": m("burst"), "bursts_a_km": m("bursts") / whole,
        }
    if of == "hiking":
        fine = lambda x: half_up(x, 9)  # noqa: E731 (running sums carry noise that would decide a tie of the roundings below)
        a_km = fine(F.coalesce(ratio(fine(m("gain")), fine(m("km"))), F.lit(0.0)))
        score, moving = fine(a_km * 10 + m("steepness") / 2), m("moving_seconds").cast("double")
        return {
            "gain_a_km": a_km, "steepest": m("steepest"), "gain_to_loss": fine(F.coalesce(ratio(fine(m("gain")), fine(m("loss"))), F.lit(0.0))), "climb_speed": half_up(m("up_speed"), 1), "climb_time": half_up(ratio(m("up_seconds").cast("double"), moving) * 100).cast("int"),
            "climb_grade": half_up(fine(ratio(fine(m("up_gain")), fine(m("up_km")) * 1000) * 100)).cast("int"), "descent_speed": half_up(m("down_speed"), 1), "descent_top": half_up(m("down_top"), 1), "descent_time": half_up(ratio(m("down_seconds").cast("double"), moving) * 100).cast("int"),
            "difficulty_score": score, "difficulty": stage(score, [(15, "very_hard"), (10, "hard"), (5, "moderate"), "easy"]),
        }
    return {}


KINDS = {"running": running, "trail": trail, "cycling": cycling, "gravel": gravel, "hiking": hiking}


def analysed(points: DataFrame, kinds: tuple[str, ...] = tuple(KINDS), fatigue: bool = True, wind: tuple[Column, Column] | None = None, climbs: dict | None = None, stop_seconds: int = 5, acceleration_scale: float = 1.0) -> DataFrame:
    """A row for each activity with the sums and results of the analyses asked for, whatever its sport.

    Columns: those of ``base``, ``climbs`` and ``stops``, a struct for each of ``kinds``, with ``fatigue`` its summary, and with ``wind``
    (speed and direction, columns of ``points``) ``aero``. ``points`` has a row for each sample: ``activity_id, idx, ts, speed, grade, moving,
    elevation, step_m, heart_rate, power, cadence, bearing``. ``sport_type``, where given, is kept. Accelerations are taken ``acceleration_scale`` times.
    """
    samples = facts(points)
    if acceleration_scale != 1.0:
        samples = samples.withColumn("acceleration", F.col("acceleration") * acceleration_scale)
    sums = base()
    for k in kinds:
        sums |= KINDS[k]()
    if wind is not None:
        samples = with_wind(samples, *wind)
        sums |= {f"aero_{k}": v for k, v in aero().items()}
    if fatigue:
        samples = prefix_sums(samples)
        sums["prefix"] = F.array_sort(F.collect_list(F.struct("idx", "sums", "km", "second")))
    if "sport_type" in points.columns:
        sums["sport_type"] = F.max("sport_type")
    one = samples.groupBy("activity_id").agg(*(v.alias(k) for k, v in sums.items()))
    if fatigue:
        one = with_fatigue(one)
    one = one.withColumns({"climbs": climbs_of(F.col("climb_runs"), **(climbs or {})), "stops": F.filter(F.transform("stop_runs", lambda r: F.struct(r["start_idx"].alias("start_idx"), r["end_idx"].alias("end_idx"), (r["second1"] - r["second0"]).alias("seconds"))), lambda s: s["seconds"] >= stop_seconds)})
    out = {k: F.struct(*(v.alias(n) for n, v in told(F.col, k).items())) for k in kinds}
    if fatigue:
        out["fatigue"] = F.col("fatigue")
    if wind is not None:
        out["aero"] = F.struct(*(F.col(f"aero_{k}").alias(k) for k in aero()))
    kept = [c for c in base() if not c.endswith("_runs")] + (["sport_type"] if "sport_type" in sums else [])
    return one.select("activity_id", *kept, "climbs", "stops", *(v.alias(k) for k, v in out.items()))
