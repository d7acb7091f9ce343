"""Quality rules with adaptive thresholds, in DataFrame functions alone.

Every document gets counts from its whole text. Rates derived from them go into quantile sketches for each language and
source: counts of logarithmic buckets with a relative width of 1/32, which merge by addition, so a group's sketch does
not depend on how its rows were dealt. Fences are the quartiles widened by a multiple of their distance. A group's
quartiles are drawn towards those of its language, and these towards those of all documents, as if PRIOR more documents
were there of the larger group: few documents say little of their own, many say nearly all. The fences are joined to the
documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headwind.session import materialize

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Words of a window; words that a text must have; percent of words in repeated windows that it may have.
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
#: Documents of the larger group that count beside a group's own.
PRIOR = 200

#: Rates: SQL over the counts, times the distance of quartiles, that distance at least, and whether too low is bad too.
#: The fences widen for texts shorter than the group's median, as rates of few words vary more. Where most texts of a
#: group have none of a rate, the least distance decides: with 3 * 80 per mille of repeated words, below the base rule's 300.
RATES = {
    "word_length": ("100 * word_chars div n_words", 6, 20, True),
    "symbols": ("1000 * n_symbols div word_chars", 3, 6, False),
    "dup_lines": ("1000 * n_dup_lines div n_lines", 3, 120, False),
    "repeats": ("1000 * n_repeat_words div n_words", 3, 80, False),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def text_counts(docs: DataFrame, keep: dict[str, Column], text: str = "text") -> DataFrame:
    """The columns keep, COUNTS and n_lines (lines with a word) of every row; a null text has none of anything.

    Each step's arrays are columns of the step before, so that no lambda computes them again for each element.
    """
    step = docs.select(*[c.alias(n) for n, c in keep.items()], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    bare = F.btrim("t", F.lit(BLANKS))
    lines = F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    step = step.select(
        *keep, F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+")).alias("w"), lines.alias("lines"),
        F.length(F.translate("t", BLANKS, "")).cast("bigint").alias("word_chars"), (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
    )
    step = step.withColumn("each", F.transform("w", lambda x: F.xxhash64(x)))
    # Words are hashed once; a window's hash is that of its words' hashes.
    hashes = F.transform(F.slice("each", 1, F.greatest(F.size("w") - (WINDOW - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get("each", i + k) for k in range(1, WINDOW)]))
    step = step.select(
        *keep, "word_chars", "n_symbols", F.size("w").cast("bigint").alias("n_words"), F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"), F.when(F.size("w") > WINDOW, hashes).otherwise(F.array().cast("array<bigint>")).alias("h"),
    )
    # Only texts with a repeated window need the places of the windows.
    placed = F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    empty = F.array().cast("array<struct<h:bigint,i:int>>")
    step = step.withColumn("p", F.when(F.size(F.array_distinct("h")) < F.size("h"), placed).otherwise(empty)).drop("h")
    same = lambda x, i: (x["h"] == F.try_element_at("p", i + 2)["h"]) | ((i > 0) & (x["h"] == F.try_element_at("p", F.greatest(i, F.lit(1)))["h"]))
    starts = F.array_sort(F.transform(F.filter("p", lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x["i"]))
    zero = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("bigint").alias("n"))
    covered = F.aggregate(starts, zero, lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(WINDOW), i - s["last"])).alias("n")), lambda s: s["n"])
    return step.withColumn("n_repeat_words", covered).drop("p")


def bucket(v: Column) -> Column:
    """The sketch bucket of a non-negative whole number: itself below 64, then 32 buckets to each power of two."""
    shift = F.greatest(F.length(F.bin(v)) - 6, F.lit(0))
    return (32 * shift + F.call_function("shiftright", v, shift)).cast("bigint")


def floor_of(b: Column) -> Column:
    """The least number of a bucket."""
    shift = F.when(b < 64, F.lit(0)).otherwise((F.floor(b / 32) - 1).cast("int"))
    return F.call_function("shiftleft", b - 32 * shift, shift)


def sketches(counts: DataFrame) -> DataFrame:
    """(level, lang, source, rate, bucket, n): sketches of each language and source (level 0), language (1) and all (3)."""
    rates = [("words", F.col("n_words")), *((name, F.expr(sql)) for name, (sql, *_) in RATES.items())]
    each = counts.select("lang", "source", F.explode(F.array(*[F.struct(F.lit(n).alias("rate"), bucket(c).alias("bucket")) for n, c in rates])).alias("r"))
    base = each.groupBy("lang", "source", "r.rate", "r.bucket").agg(F.count("*").alias("n"))
    kinds = [(0, F.col("lang"), F.col("source")), (1, F.col("lang"), F.lit(None).cast("string")), (3, F.lit(None).cast("string"), F.lit(None).cast("string"))]
    merged = base.select(F.explode(F.array(*[F.struct(F.lit(k).alias("level"), a.alias("lang"), b.alias("source")) for k, a, b in kinds])).alias("g"), "rate", "bucket", "n")
    return merged.groupBy("g.level", "g.lang", "g.source", "rate", "bucket").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame, prior: int = PRIOR) -> DataFrame:
    """(lang, source, words, <rate>_q1, <rate>_q3): the median of words and the quartiles that hold for each group."""
    group = ["level", "lang", "source", "rate"]
    below = Window.partitionBy(*group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = sketch.withColumn("upto", F.sum("n").over(below)).withColumn("all", F.sum("n").over(Window.partitionBy(*group)))
    quartile = lambda k, rate: F.min(F.when((F.col("rate") == rate) & (4 * F.col("upto") >= k * F.col("all")), floor_of(F.col("bucket"))))
    names = ["words", *[f"{r}_q{k}" for r in RATES for k in (1, 3)]]
    wanted = [quartile(2, "words").alias("words")] + [quartile(k, r).alias(f"{r}_q{k}") for r in RATES for k in (1, 3)]
    levels = ranked.groupBy("level", "lang", "source").agg(F.max("all").cast("double").alias("n"), *wanted)
    whole = levels.where("level = 3").first()  # one row
    # A value of its own n documents and of `prior` ones of the larger group.
    drawn = lambda n, own, larger: (n * own + F.lit(float(prior)) * larger) / (n + F.lit(float(prior)))
    tongue = levels.where("level = 1").select(F.col("lang").alias("lang1"), *[drawn(F.col("n"), F.col(c), F.lit(whole[c] if whole else None)).alias(f"{c}_1") for c in names])
    own = levels.where("level = 0").join(tongue, F.col("lang").eqNullSafe(F.col("lang1")))
    return own.select("lang", "source", *[drawn(F.col("n"), F.col(c), F.col(f"{c}_1")).alias(c) for c in names])


def apply_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", prior: int = PRIOR) -> DataFrame:
    """One row for each row of docs: doc_id, COUNTS, base_failed, kept.

    base_failed: fewer than LEAST_WORDS words, or more than MOST_REPEATED percent of them in windows of WINDOW words that
    the text has twice or more. kept: not base_failed, and every rate within the fences of the row's language and source.
    Sketches cover all rows that are not base_failed. A null text has no words and fails; null languages and sources are
    groups of their own; repeated rows each count; an empty table gives no rows. Other columns play no part.
    """
    keep = {"doc_id": F.col(f"`{doc_id}`"), "lang": F.col(f"`{lang}`").cast("string"), "source": F.col(f"`{source}`").cast("string")}
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    counted = materialize(text_counts(docs, keep, text).withColumn("base_failed", failed), "rules-counts")
    limits = fences(materialize(sketches(counted.where("not base_failed")), "rules-sketches"), prior)
    limits = limits.withColumnsRenamed({"lang": "of_lang", "source": "of_source"})
    joined = counted.join(limits, F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source")), "left")
    room = F.sqrt(F.greatest(F.lit(1.0), F.col("words") / F.col("n_words")))
    good = F.lit(True)
    for rate, (sql, times, least, both) in RATES.items():
        spread = times * F.greatest(F.col(f"{rate}_q3") - F.col(f"{rate}_q1"), F.lit(least)) * room
        good &= F.expr(sql) <= F.col(f"{rate}_q3") + spread
        if both:
            good &= F.expr(sql) >= F.col(f"{rate}_q1") - spread
    return joined.select("doc_id", *COUNTS, "base_failed", F.when(F.col("base_failed"), False).otherwise(F.coalesce(good, F.lit(False))).alias("kept"))
