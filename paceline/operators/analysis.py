"""The whole analysis of activities by sport, in three depths, and the document made of it."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.functions.scalars import half_up
from paceline.operators import sports
from paceline.operators.insights import fixed, insights
from paceline.operators.points import climb_category

#: The streams that every analysis needs, and what sports need besides.
STREAMS = ("time", "latlng", "distance", "altitude", "velocity_smooth", "grade_smooth", "moving")
MORE_STREAMS = [(("run",), ("heartrate", "cadence")), (("ride", "bike"), ("heartrate", "cadence", "watts")), (("hike", "walk"), ("heartrate",))]


@dataclass(frozen=True)
class Plan:
    """What to work out. Quick leaves out wind, fatigue stays; deep takes all and needs the wind's columns in the samples."""

    fatigue: bool = True
    wind: bool = False
    insights: bool = True
    climbs: tuple = ()
    stop_seconds: int = 5

    @classmethod
    def mode(cls, name: str = "normal", **changes) -> Plan:
        return replace({"quick": cls(), "normal": cls(), "deep": cls(wind=True)}[name], **changes)


def analyse(points: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """A row for each activity: ``sports.analysed``, the ``kind`` of analysis, a null struct for the analyses of other kinds, and ``insights``.

    All kinds are summed up in one pass, so activities of all sports share one exchange; results of a kind that isn't the
    activity's own are null. With ``plan.wind`` the samples have ``wind_speed`` and ``wind_direction``.
    """
    wind = (F.col("wind_speed"), F.col("wind_direction")) if plan.wind else None
    out = sports.analysed(points, fatigue=plan.fatigue, wind=wind, climbs=dict(plan.climbs), stop_seconds=plan.stop_seconds).withColumn("kind", sports.kind(F.col("sport_type")))
    covers = {"running": ("running", "trail"), "cycling": ("cycling", "gravel")}
    out = out.withColumns({k: F.when(F.col("kind").isin(*covers.get(k, (k,))), F.col(k)) for k in sports.KINDS})
    if not plan.insights:
        return out
    none = F.lit(None).cast("struct<detected: boolean, onset_km: double, severity: double>")
    return out.withColumn("insights", insights({c: F.col(c) for c in out.columns} | ({} if plan.fatigue else {"fatigue": none})))


def document(analysed: DataFrame) -> DataFrame:
    """The analysis as a nested document: ``metadata``, ``summary``, ``detailed`` (climbs with names and categories, stops, the sport's own results, fatigue, and aero if there is) and ``insights``."""
    climb = F.transform("climbs", lambda c: F.struct(
        F.concat(F.lit("Climb "), fixed(c["km"], 1), F.lit("km @ "), fixed(c["grade"], 1), F.lit("%")).alias("name"), half_up(c["km"], 2).alias("distance"), half_up(c["gain"]).alias("elevation_gain"), half_up(c["grade"], 1).alias("avg_grade"),
        half_up(c["max_grade"], 1).alias("max_grade"), climb_category(c["km"], c["grade"]).alias("category"), half_up(c["vam"]).alias("vam"), duration(c["seconds"]).alias("duration"),
    ))
    own = F.struct(*(k for k in sports.KINDS))
    rest = [F.col("aero")] if "aero" in analysed.columns else []
    return analysed.select(
        "activity_id", F.struct("activity_id", "sport_type", "kind").alias("metadata"),
        F.struct(
            half_up(F.col("km"), 2).alias("distance"), duration(F.col("seconds")).alias("duration"), duration(F.col("moving_seconds")).alias("moving_time"), half_up(half_up(F.col("gain"), 6)).alias("elevation_gain"), half_up(half_up(F.col("loss"), 6)).alias("elevation_loss"),
            half_up(F.col("speed"), 2).alias("avg_speed"), half_up(F.col("top_speed"), 2).alias("max_speed"), half_up(F.col("hr")).alias("avg_hr"), F.col("hr_max").alias("max_hr"), F.col("running.pace").alias("avg_pace"), half_up(F.col("watts")).alias("avg_power"),
            half_up(F.col("cycling.np")).alias("normalized_power"), F.col("cycling.tss").alias("tss"), half_up(F.col("cadence")).alias("cadence_avg"), F.size("climbs").alias("climbs"), F.size("stops").alias("stops"),
        ).alias("summary"),
        F.struct(climb.alias("climbs"), "stops", own.alias("sport_analysis"), *([F.col("fatigue")] if "fatigue" in analysed.columns else []), *rest).alias("detailed"), *(["insights"] if "insights" in analysed.columns else []),
    )


def duration(seconds: Column) -> Column:
    """Hours and minutes, below an hour minutes and seconds."""
    s = seconds.cast("long")
    h, m = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60)
    return F.when(h > 0, F.format_string("%dh %dm", h, m)).otherwise(F.format_string("%dm %ds", m, F.pmod(s, F.lit(60))))


def required_streams(activities: DataFrame, sport: str = "sport_type") -> DataFrame:
    """Adds ``streams``, what the analysis of an activity's sport reads; an unknown or null sport needs the streams that all need."""
    name, more = F.lower(F.coalesce(F.col(sport), F.lit(""))), F.array().cast("array<string>")
    for held, extra in reversed(MORE_STREAMS):
        hit = F.lit(False)
        for part in held:
            hit = hit | name.contains(part)
        more = F.when(hit, F.array(*map(F.lit, extra))).otherwise(more)
    return activities.withColumn("streams", F.concat(F.array(*map(F.lit, STREAMS)), more))
