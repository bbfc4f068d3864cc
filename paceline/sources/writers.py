"""Sinks: point and table CSV, GPX, JSON and versioned snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def points_csv(points: DataFrame, path: str, decimals: dict[str, int]) -> None:
    """Points as CSV in order of activity and index, measures with fixed decimals, nulls empty."""
    fixed = {c: F.format_string(f"%.{n}f", F.col(c).cast("double")) for c, n in decimals.items()}
    shown = points.select(*[F.when(F.col(c).isNotNull(), fixed[c]).alias(c) if c in fixed else F.col(c) for c in points.columns])
    shown.repartitionByRange("activity_id", "idx").sortWithinPartitions("activity_id", "idx").write.mode("overwrite").option("header", "true").csv(path)


def table_csv(df: DataFrame, path: str, columns: list[str], quote_all: bool = False) -> None:
    dashless = [F.when(F.col(c).cast("string") != "–", F.col(c).cast("string")).alias(c) for c in columns]
    df.select(*dashless).write.mode("overwrite").option("header", "true").option("quoteAll", str(quote_all).lower()).csv(path)


def escaped(text: Column) -> Column:
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


# What a point's measures are called in a GPX file, and how they are written.
GPX_MEASURES = {"speed": ("speed", "%.2f"), "heart_rate": ("heartrate", None), "cadence": ("cadence", None), "power": ("power", None), "temperature": ("temperature", "%.1f")}
GPX_NAMESPACE = "http://www.topografix.com/GPX/1/1"


def gpx(points: DataFrame, names: DataFrame) -> DataFrame:
    """``activity_id, gpx``: one GPX 1.1 document per activity; points without a position (null or zero) are left out,
    and so are measures that ``points`` has no column for or that are null."""
    placed = points.where("coalesce(lat, 0) <> 0 and coalesce(lon, 0) <> 0")
    measures = [(tag, F.format_string(shown, F.col(c)) if shown else F.col(c).cast("string"), F.col(c)) for c, (tag, shown) in GPX_MEASURES.items() if c in points.columns]
    extra = F.concat(F.lit(""), *[F.when(c.isNotNull(), F.concat(F.lit(f"<{tag}>"), text, F.lit(f"</{tag}>"))).otherwise("") for tag, text, c in measures])
    point = F.concat(
        F.format_string('<trkpt lat="%.6f" lon="%.6f">', "lat", "lon"), F.when(F.col("elevation").isNotNull(), F.format_string("<ele>%.2f</ele>", "elevation")).otherwise(""),
        F.date_format("ts", "'<time>'yyyy-MM-dd'T'HH:mm:ss.SSS'Z</time>'"), F.lit("<extensions>"), extra, F.lit("</extensions></trkpt>"),
    )
    lines = placed.groupBy("activity_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", point.alias("p")))), lambda s: s["p"]), "").alias("body"))
    title = escaped(F.coalesce("name", F.lit("")))
    head = F.concat(F.lit(f'<?xml version="1.0" encoding="UTF-8"?><gpx version="1.1" creator="paceline" xmlns="{GPX_NAMESPACE}"><metadata><name>'), title, F.lit("</name></metadata><trk><name>"), title, F.lit("</name><trkseg>"))
    return lines.join(names, "activity_id", "left").select("activity_id", F.concat(head, "body", F.lit("</trkseg></trk></gpx>")).alias("gpx"))


def as_json(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, F.to_json(F.struct(*df.columns)).alias("json"))


def snapshot(df: DataFrame, path: str, version: str, at: str) -> None:
    df.withColumns({"version": F.lit(version), "ingested_at": F.lit(at).cast("timestamp")}).write.mode("overwrite").parquet(path)
