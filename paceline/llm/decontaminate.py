"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Numbers, units and names in a text are replaced by typed placeholders, so a question whose numbers or
names were changed has the same template. Windows of template tokens of the documents are hash-joined
with those of the benchmark; a document that covers enough of an item's windows, and whose slots agree
with the item's (equal values in the item stay equal in the document, units keep their dimension), has
leaked the item. Both are judged for each occurrence in the document and for all of it together.

Texts are never shuffled: windows are hashed and looked up in the task that reads them. The
benchmark's windows are broadcast while they are fewer than a stated number, and shuffle-joined beyond it.

Most documents hold nothing of the benchmark, so a cheap test that loses nothing comes first. A document
that covers an item holds one at least of any of its windows that are more than the share it may lack;
of the item's windows those with the rarest neighbouring words are taken, and a document none of whose
neighbouring words are among them (looked up in a bitmap of their hashes) can't cover any item.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paceline.llm.common import read_table, stored, text_or_empty, unused

# Units by dimension. A unit may be swapped for another of its own dimension only.
UNITS = {
    "length": ["km", "m", "cm", "mm", "mi", "miles", "mile", "ft", "feet", "yd", "yards", "inches", "inch", "meters", "metres", "kilometers", "kilometres"],
    "mass": ["kg", "g", "mg", "lb", "lbs", "oz", "pounds", "ounces", "grams", "kilograms", "tons", "tonnes"],
    "time": ["h", "hr", "hrs", "hour", "hours", "min", "mins", "minute", "minutes", "s", "sec", "secs", "seconds", "days", "day", "weeks", "week", "months", "years", "year"],
    "money": ["usd", "eur", "gbp", "dollars", "dollar", "euros", "euro", "cents", "€", "£", "\\$"],
    "share": ["%", "percent"],
    "volume": ["l", "ml", "liters", "litres", "gallons", "cups"],
    "speed": ["mph", "kmh", "knots"],
}


@dataclass(frozen=True)
class Settings:
    #: tokens of a window; items with fewer tokens are one window of their own length
    window: int = 8
    #: least share of an item's windows that a document must hold
    coverage: float = 0.5
    #: benchmark windows that are broadcast, at most (several hundred bytes each); beyond that they are shuffle-joined, and
    #: every document is cut into windows
    broadcast_windows: int = 400_000
    #: anchors of the cheap test, at most (some 20 bytes each in the plan); beyond that every document is cut into windows
    most_anchors: int = 50_000


def marked(text: Column) -> Column:
    """Tokens of the text with slots written as ``#n_value`` (number), ``#u_unit`` (its unit or nothing), ``#p_name`` and
    ``#q_word``.

    A name is a word within a sentence whose first letter only is a capital; such a word elsewhere, as where a sentence
    begins, may be one (``#q``). Everything else is lower-cased and stripped of punctuation. A blank text gives one empty token.
    """
    units = "|".join(sorted((u for group in UNITS.values() for u in group), key=lambda u: (-len(u), u)))
    s = F.translate(text, "#_", "  ")
    s = F.regexp_replace(s, r"(?<=[\p{Ll},;:]\s)(\p{Lu}\p{Ll}+)(?!\p{L})", "#p_$1")
    s = F.regexp_replace(s, r"(?<![\p{L}\p{N}_])(\p{Lu}\p{Ll}+)(?!\p{L})", "#q_$1")
    s = F.regexp_replace(F.lower(s), r"(?<=\d)[.,](?=\d)", "d")
    s = F.regexp_replace(s, rf"(?<![\p{{L}}\d_])(\d[\dd]*) ?({units})?(?![\p{{L}}\d])", " #n_$1 #u_$2 ")
    s = F.regexp_replace(s, r"[^\p{L}\p{N}#_%€£$]+", " ")
    return F.split(F.trim(s), " ")


#: Forms in which windows are looked for: doubtful names as words, as names, and all values as they stand.
FORMS = ("words", "names", "values")


def in_form(raw: Column, form: str) -> Column:
    if form == "names":
        return F.transform(raw, lambda t: F.when(t.startswith("#q"), F.concat(F.lit("#p"), F.substring(t, 3, 1_000_000))).otherwise(t))
    own = (lambda t: t.startswith("#q")) if form == "words" else (lambda t: t.startswith("#q") | t.startswith("#p"))
    return F.transform(raw, lambda t: F.when(own(t), F.substring(t, 4, 1_000_000)).otherwise(t))


def template(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.when(t.startswith("#"), F.substring(t, 1, 2)).otherwise(t))


def windows(tokens: Column, width: int) -> Column:
    """Hash of each window of ``width`` template tokens, in order; none if the text is shorter."""
    n = F.size(tokens)
    return F.when(n >= width, F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(F.slice(tokens, i + 1, width)))).otherwise(F.array().cast("array<bigint>"))


def dimension(unit: Column) -> Column:
    flat = [F.lit(x) for name, group in UNITS.items() for u in group for x in (u.replace("\\", ""), name)]
    return F.coalesce(F.create_map(*flat)[unit], F.lit(""))


def benchmark_windows(benchmark: DataFrame, settings: Settings, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``form, item_id, width, n_windows, at, h, w, slots`` per distinct usable window of each item. A window needs words in
    half its places, lest placeholders alone match; an item none of whose windows has them is looked for by its values."""
    items = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item_id"), marked(text_or_empty(text_col)).alias("raw"))
    items = items.where("size(raw) > 1 or raw[0] <> ''").withColumn("width", F.least(F.lit(settings.window), F.size("raw")))
    items = items.select("item_id", "width", F.explode(F.array(*[F.struct(F.lit(f).alias("form"), in_form(F.col("raw"), f).alias("raw")) for f in FORMS])).alias("z")).select("item_id", "width", "z.form", "z.raw")
    items = items.withColumn("tokens", F.when(F.col("form") == "values", F.col("raw")).otherwise(template(F.col("raw"))))
    at = F.explode(F.sequence(F.lit(0), F.size("tokens") - F.col("width")))
    cut = items.withColumn("at", at).select("form", "item_id", "width", "at", F.expr("slice(tokens, at + 1, width)").alias("w"), F.expr("slice(raw, at + 1, width)").alias("r"))
    wordy = cut.where((F.col("form") != "values") & (F.size(F.filter("w", lambda t: ~t.startswith("#"))) * 2 >= F.col("width")))
    usable = wordy.unionByName(cut.where("form = 'values'").join(wordy.select("item_id").distinct(), "item_id", "left_anti"))
    n = usable.groupBy("form", "item_id").agg(F.countDistinct("at").alias("n_windows"))
    return usable.select("form", "item_id", "width", "at", F.xxhash64("w").alias("h"), "w", slots(F.col("r")).alias("slots")).join(n, ["form", "item_id"])


def slots(raw: Column) -> Column:
    return F.filter(raw, lambda t: t.startswith("#"))


LETTERS = r"^\p{L}+$"


def anchors(known: DataFrame, settings: Settings) -> DataFrame:
    """``kind, h`` of the anchors of which a document holds one at least if it covers an item: of each item's windows so many as
    no covering document can lack, each by its rarest pair of neighbouring words, word or number in the benchmark.
    ``kind`` is ``b``, ``u``, ``d``, or ``-`` where a window has none of them."""
    plain = lambda t: t.rlike(LETTERS)
    entry = lambda kind, text, h: F.struct(F.lit(kind).alias("kind"), text.alias("text"), h.alias("h"))
    pairs = F.zip_with("w", F.slice("w", F.lit(2), F.size("w")), lambda a, b: F.when(plain(a) & plain(b), entry("b", F.concat_ws(" ", a, b), F.xxhash64(a, b))))
    words = F.transform("w", lambda a: F.when(plain(a), entry("u", a, F.xxhash64(a))))
    number = lambda t: F.regexp_extract(t, r"^#n_(\d+)", 1)
    numbers = F.transform("w", lambda t: F.when(number(t) != "", entry("d", number(t), F.xxhash64(number(t)))))
    some = F.filter(F.concat(pairs, words, numbers), lambda x: x.isNotNull())
    every = F.when(F.size(some) > 0, some).otherwise(F.array(entry("-", F.lit(""), F.lit(0).cast("long"))))
    told = known.select("form", "item_id", "at", "n_windows", F.explode(every).alias("x")).select("form", "item_id", "at", "n_windows", "x.*")
    seen = told.groupBy("kind", "text").agg(F.countDistinct("item_id").alias("items"))
    rank = F.struct((F.col("kind") == "-").alias("none"), "items", F.col("kind"), (-F.length("text")).alias("short"), "text", "h")
    best = told.join(seen, ["kind", "text"]).groupBy("form", "item_id", "at").agg(F.min(rank).alias("best"), F.first("n_windows").alias("n"))
    place = F.row_number().over(Window.partitionBy("form", "item_id").orderBy("best", "at"))
    enough = F.floor((1 - settings.coverage) * F.col("n") + 1e-9) + 1
    return best.withColumn("place", place).where(F.col("place") <= enough).select("best.kind", "best.h").distinct()


def may_leak(text: Column, found: dict[str, list[int]]) -> Column:
    """Whether the text holds one of the anchors (hashes by kind). A bitmap of hashes may say yes in error, never no."""
    if "-" in found:
        return F.lit(True)
    return functools.reduce(lambda a, b: a | b, [holds_one(text, kind, hashes) for kind, hashes in found.items()], F.lit(False))


def holds_one(text: Column, kind: str, hashes: list[int]) -> Column:
    """Whether one of the text's pairs of neighbouring words, words or numbers is among the hashes: three bits of each are set
    in a bitmap of 128 to 256 bits a hash, which stands in the plan as words of 64 bits."""
    size = 1 << max(12, (128 * len(hashes) - 1).bit_length())
    bits = [0] * (size // 64)
    for h in hashes:
        for k in (0, 21, 42):
            place = (h >> k) % size
            bits[place // 64] |= 1 << place % 64
    table = F.split(F.lit(",".join(str(x - (1 << 64) if x >> 63 else x) for x in bits)), ",").cast("array<bigint>")

    def at(h: Column) -> Column:
        place = F.pmod(h, F.lit(size)).cast("int")
        return F.getbit(F.get(table, F.shiftright(place, 6)), place.bitwiseAND(F.lit(63))) == 1

    def known(h: Column) -> Column:
        return at(h) & at(F.shiftright(h, 21)) & at(F.shiftright(h, 42))

    def hashed(words: Column) -> Column:
        if kind == "b":
            return F.zip_with(words, F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.xxhash64(a, b))
        return F.transform(words, lambda a: F.xxhash64(a))

    words = F.split(text, r"\D+") if kind == "d" else F.split(F.lower(text), r"[^\p{L}]+")
    # the words are bound once, as the one element of an array
    return F.exists(F.array(words), lambda w: F.exists(hashed(w), known))


def leaks(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """``id_col, item_id, windows, coverage, exact`` for each document row and item that it leaks.

    ``windows`` counts the item's windows that the document holds, ``coverage`` is their share, and ``exact`` says that
    all slots in them have the item's own values. Rows with a null id are compared like others and give null ids; rows
    that repeat an id with another text are judged by themselves, equal rows once. Empty texts and items leak nothing.
    """
    return judged(docs, benchmark, settings, id_col, text_col, item_col).select(id_col, "item_id", "windows", "coverage", "exact")


def judged(docs: DataFrame, benchmark: DataFrame, settings: Settings, id_col: str, text_col: str, item_col: str) -> DataFrame:
    """``leaks`` with ``text_hash``, the hash of the row's text."""
    known = stored(benchmark_windows(benchmark, settings, item_col), "windows")
    widths = [(r["form"], r["width"], r["n"]) for r in known.groupBy("form", "width").agg(F.count("*").alias("n")).orderBy("form", "width").collect()]  # at most three times ``window`` rows
    small = sum(n for *_, n in widths) <= settings.broadcast_windows
    docs = docs.select(id_col, text_col)
    if small and widths:
        by_kind: dict[str, list[int]] = {}
        told = anchors(known, settings).limit(settings.most_anchors + 1).collect()
        for r in told:
            by_kind.setdefault(r["kind"], []).append(r["h"])
        if len(told) <= settings.most_anchors:
            docs = stored(docs.where(may_leak(text_or_empty(text_col), by_kind)), "candidates")  # read once for each form
    marks = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_or_empty(text_col)).alias("_text"), marked(text_or_empty(text_col)).alias("raw"))
    found = None
    for form, width, _ in widths:
        read = marks.withColumn("raw", in_form(F.col("raw"), form))
        read = read.withColumn("tokens", F.col("raw") if form == "values" else template(F.col("raw")))
        ours = read.select("_id", "_text", "raw", "tokens", F.posexplode(windows(F.col("tokens"), width)).alias("pos", "h"))
        slot_texts = slots(F.expr(f"slice(raw, pos + 1, {width})"))
        words = F.expr(f"slice(tokens, pos + 1, {width})")
        theirs = known.where((F.col("width") == width) & (F.col("form") == form)).select("form", "item_id", "at", "h", "w", F.col("slots").alias("theirs"), "n_windows")
        shown = ["_id", "_text", "form", "item_id", "at", "pos", "n_windows", "theirs"]
        if small:
            hit = ours.join(F.broadcast(theirs), "h").where(words == F.col("w")).select(*shown, slot_texts.alias("ours"))
        else:
            hit = ours.select("_id", "_text", "pos", "h", words.alias("words"), slot_texts.alias("ours")).join(theirs, "h").where("words = w").select(*shown, "ours")
        found = hit if found is None else found.unionByName(hit)
    kind = docs.schema[id_col].dataType.simpleString()
    if found is None:
        item = benchmark.schema[item_col].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"{id_col} {kind}, item_id {item}, text_hash long, windows long, coverage double, exact boolean")
    # an occurrence is the hits at one shift, a run of neighbouring shifts (an edit within a copy moves what follows), or
    # all hits of the document; one that holds is enough
    by_shift = Window.partitionBy("_id", "_text", "form", "item_id").orderBy("shift")
    near = F.least(F.lit(settings.window), F.col("n_windows"))
    found = found.withColumn("shift", F.col("pos") - F.col("at"))
    found = found.withColumn("new", F.coalesce((F.col("shift") - F.lag("shift").over(by_shift) >= near).cast("int"), F.lit(0))).withColumn("run", F.sum("new").over(by_shift).cast("int"))
    kinds = [F.struct(F.lit(k).alias("kind"), v.cast("int").alias("nr")) for k, v in (("all", F.lit(0)), ("run", F.col("run")), ("shift", F.col("shift")))]
    found = found.withColumn("occurrence", F.explode(F.array(*kinds)))
    key = ["_id", "_text", "form", "item_id", "occurrence"]
    # a passage that an occurrence repeats counts once for each reading of its slots
    distinct = found.select(*key, "at", "theirs", "ours", "n_windows").distinct()
    covered = distinct.groupBy(*key).agg(F.countDistinct("at").alias("windows"), F.first("n_windows").alias("n_windows"), F.max(F.size("theirs")).alias("any_slots")).where(F.col("windows") >= settings.coverage * F.col("n_windows")).withColumn("_text_", F.col("_text"))
    pair = distinct.where(F.size("theirs") > 0).select(*key, F.explode(F.arrays_zip("theirs", "ours")).alias("z")).select(*key, F.col("z.theirs").alias("theirs"), F.col("z.ours").alias("ours")).distinct()
    unit = F.col("theirs").startswith("#u") & (dimension(F.substring("theirs", 4, 100)) != dimension(F.substring("ours", 4, 100)))
    one_reading = pair.groupBy(*key, "theirs").agg(F.count("*").alias("readings"), F.max(F.col("ours") == F.col("theirs")).alias("own"), F.max(unit).alias("clash"))
    # slots clash where the item's value has several readings, none of them its own, or a unit changes its dimension
    judged = one_reading.groupBy(*key).agg(F.max(((F.col("readings") > 1) & ~F.col("own")) | (F.col("clash") & ~F.col("own"))).alias("clashes"), F.min("own").alias("same"))
    out = covered.join(judged, [covered[c].eqNullSafe(judged[c]) for c in key], "left").where(~F.coalesce("clashes", F.lit(False)))
    held = out.select(covered["_id"].alias(id_col), "_text_", covered["item_id"], "windows", (F.col("windows") / F.col("n_windows")).alias("coverage"), F.coalesce("same", F.lit(True)).alias("exact"))
    best = held.groupBy(id_col, "_text_", "item_id").agg(F.max(F.struct("coverage", "windows")).alias("best"), F.max("exact").alias("exact"))
    return best.select(id_col, "item_id", F.col("_text_").alias("text_hash"), F.col("best.windows").alias("windows"), F.col("best.coverage").alias("coverage"), "exact")


def drop_leaked(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """``docs`` without the rows that leak an item. Rows that repeat an id, and those without one, are judged each by its own
    text. Other columns stay as they are, whatever their names."""
    found = judged(docs, benchmark, settings, id_col, text_col, item_col)
    leaked, own = unused(docs, "leaked_id", "leaked_text")
    side = found.select(F.col(id_col).alias(leaked), F.col("text_hash").alias(own)).distinct()
    return docs.join(side, F.col(id_col).eqNullSafe(F.col(leaked)) & (F.xxhash64(text_or_empty(text_col)) == F.col(own)), "left_anti")


def op9_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "benchmark"))
