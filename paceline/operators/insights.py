"""What is worth saying about an analysed activity: a list of rules, each with its condition and its sentence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.functions.scalars import half_up, pace_text, ratio


def spent(seconds: Column) -> Column:
    s = half_up(seconds).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60))
    return F.when(h > 0, F.format_string("%dh %dm %ds", h, m, r)).when(m > 0, F.format_string("%dm %ds", m, r)).otherwise(F.format_string("%ds", r))


def fixed(x: Column, digits: int) -> Column:
    """``x`` with so many decimals, null for null, of which ``format_string`` would make the first letters of "null"."""
    return F.when(x.isNotNull(), F.format_string(f"%.{digits}f", half_up(x, digits)))


def rules(a: dict[str, Column]) -> list[tuple[str, Column, Column]]:
    """Code, condition and sentence of each rule, in order. ``a`` has the columns of ``sports.analysed`` and ``kind``; what wasn't asked for is null."""
    n = lambda x: fixed(x, 0)
    fatigue, cycling, running, trail = a["fatigue"], a["cycling"], a["running"], a["trail"]
    riding, on_foot = a["kind"].isin("cycling", "gravel"), a["kind"].isin("running", "trail")
    hardest = F.element_at(F.array_sort(F.transform(a["climbs"], lambda c: F.struct(c["grade"].alias("grade"), (-c["start_idx"]).alias("at"), c["km"].alias("km")))), -1)
    vam = F.array_max(F.filter(F.transform(a["climbs"], lambda c: c["vam"]), lambda v: v > 0))
    some = F.size(a["climbs"]) > 0
    text = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    return [
        ("done", a["km"].isNotNull(), text("Completed ", fixed(a["km"], 2), " km in ", spent(a["moving_seconds"]))),
        ("slow", a["speed"] < 10, text("Average speed was ", fixed(a["speed"], 1), " km/h")),
        ("quick", a["speed"] > 30, text("Quick pace! Average speed was ", fixed(a["speed"], 1), " km/h")),
        ("climbing", a["gain"] > 500, text("Significant climbing: ", n(a["gain"]), "m of elevation gain")),
        ("pace", on_foot & running["pace"].isNotNull(), text("Average pace: ", pace_text(running["pace"]), "/km")),
        ("gain", a["gain"] > 200, text("Elevation gain of ", n(a["gain"]), "m (", fixed(ratio(a["gain"], a["km"]), 1), "m/km average gradient)")),
        ("onset", fatigue["detected"] & (fatigue["onset_km"] > 0), text("Fatigue detected at km ", fixed(fatigue["onset_km"], 1))),
        ("severe", fatigue["detected"] & (fatigue["severity"] > 0.75), F.lit("Severe fatigue impact detected during the activity")),
        ("moderate", fatigue["detected"] & (fatigue["severity"] > 0.5) & (fatigue["severity"] <= 0.75), F.lit("Moderate fatigue indicators observed")),
        ("gap", (a["kind"] == "trail") & trail["gap"].isNotNull(), text("Grade-adjusted pace (GAP) average: ", pace_text(trail["gap"]), "/km")),
        ("power", a["watts"] > 0, text("Average power: ", n(a["watts"]), "W")),
        ("np", riding & (a["watts"] > 0) & (cycling["np"] > 0), text("Normalized power: ", n(cycling["np"]), "W")),
        ("tss", riding & (a["watts"] > 0) & (cycling["tss"] != 0), text("Training Stress Score (TSS): ", cycling["tss"].cast("string"))),
        ("climb_vam", riding & (a["watts"] > 0) & cycling["best_vam"].isNotNull(), text("Best VAM on climbs: ", cycling["best_vam"].cast("string"), " m/h")),
        ("hr", a["hr"] > 0, text("Average heart rate: ", n(a["hr"]), " bpm (max ", n(a["hr_max"]), " bpm)")),
        ("drift", (a["hr"] > 0) & (half_up(a["hr_drift"]) > 5), text("Heart rate drift: +", n(a["hr_drift"]), "% (signs of fatigue)")),
        ("steady", (a["hr"] > 0) & (half_up(a["hr_drift"]) < -5), F.lit("Negative HR drift: good pacing stability")),
        ("hardest", some, text("Hardest climb: ", fixed(hardest["km"], 2), "km at ", fixed(hardest["grade"], 1), "%")),
        ("vam", some & vam.isNotNull(), text("Best VAM: ", n(vam), " m/h")),
        ("cadence", on_foot & running["cadence_stability"].isNotNull(), text("Cadence stability: ", running["cadence_stability"].cast("string"), "% (", running["cadence_consistency"], ")")),
    ]


def insights(a: dict[str, Column]) -> Column:
    """The sentences that hold, as an array of (priority, code, text) in order."""
    return F.array_compact(F.array(*(F.when(F.coalesce(held, F.lit(False)), F.struct(F.lit(k + 1).alias("priority"), F.lit(code).alias("code"), sentence.alias("text"))) for k, (code, held, sentence) in enumerate(rules(a)))))


def insight_rows(analysed: DataFrame) -> DataFrame:
    """``activity_id, priority, code, text``, a row for each sentence. An outer generator, so that no filter on the size of the list is
    inferred, which would repeat all that the list is made of."""
    return analysed.select("activity_id", F.inline_outer("insights")).where("code is not null")
