"""URL filters by dated lists, in DataFrame functions alone.

Dated entries (list, pattern, day, action) become validity intervals, and each capture of a URL is joined as of its
fetch time with the entries that were active then, to the microsecond. A pattern is a domain, which covers its
subdomains, a whole IP address, or a host and the first segments of a path, however many; the case of a path counts.
Captures are joined by the patterns that could cover them and by month; a pattern and month with a large part of the
captures is dealt to several tasks. Rows of one URL and time are judged once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headwind.session import materialize

#: Segments of the path prefixes that covering_patterns() makes unless told how deep the patterns are.
SEGMENTS = 3
#: Tasks to which a hot key is dealt; a key is hot from this part of all rows on, so there are at most 1 / HOT hot keys.
SALTS, HOT = 32, 0.005
_ADDRESS = r"^(\[.*\]|[0-9]+(\.[0-9]+){3})$"


def host_of(url: Column) -> Column:
    """The lower-case host, without user, port and a final dot; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/:?#]*)", 1))
    host = F.regexp_replace(host, r"\.+\z", "")
    return F.when(host != "", host)


def path_of(url: Column) -> Column:
    """The path without its first and last slashes, query and fragment."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/*([^?#]*)", 1)
    return F.rtrim(path, F.lit("/"))


def covering_patterns(url: Column, segments: int = SEGMENTS) -> Column:
    """All patterns that cover a URL: its host and every parent domain of two labels or more, and path prefixes.

    An IP address, by numbers or in square brackets, has no parent domain.
    """
    host = host_of(url)
    labels = F.when(host.rlike(_ADDRESS), F.array(host)).otherwise(F.split(host, r"\."))
    domains = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parts = F.filter(F.split(path_of(url), "/+"), lambda x: x != "")
    prefixes = F.transform(F.slice(F.sequence(F.lit(0), F.size(parts)), 2, segments), lambda k: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, 1, k), "/")))
    return F.when(host.isNotNull(), F.concat(domains, prefixes)).otherwise(F.array().cast("array<string>"))


def validity(entries: DataFrame) -> DataFrame:
    """(list, pattern, since, until) from (list, pattern, day, action): active from since on, until null or the time it ends.

    day is a date, which is its first moment, or a timestamp. Actions are `add` and `remove`; others and rows with a null
    are left out. Of one pattern's entries of one time a removal holds. An addition while active begins another interval;
    a removal while inactive does nothing. Intervals of one list and pattern never overlap. Hosts are lower-cased, paths
    are not.
    """
    host = F.substring_index("pattern", "/", 1)
    pattern = F.concat(F.lower(host), F.substring("pattern", F.length(host) + 1, F.length("pattern")))
    kept = entries.select(F.lower("list").alias("list"), F.rtrim(pattern, F.lit("/")).alias("pattern"), F.col("day").try_cast("timestamp").alias("at"), (F.col("action") == "remove").cast("int").alias("off")).where("action in ('add', 'remove')").dropna()
    once = kept.groupBy("list", "pattern", "at").agg(F.max("off").alias("off"))
    following = F.lead("at").over(Window.partitionBy("list", "pattern").orderBy("at"))
    return once.withColumn("until", following).where("off = 0").select("list", "pattern", F.col("at").alias("since"), "until")


def _hot(counted: DataFrame, *key: str) -> DataFrame:
    """The keys of counted (key..., n) that hold HOT of all rows or more: at most 1 / HOT keys, so they can be broadcast."""
    total = counted.agg(F.sum("n")).first()[0] or 0
    return materialize(counted.where(F.col("n") >= F.lit(max(1.0, HOT * total))).select(*key), "url-hot")


def judge_captures(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched") -> DataFrame:
    """Every row of captures as the struct `row`, with blocked, n_active, list, pattern and since.

    n_active: entries that cover the URL and were active at `fetched` (since <= fetched < until), a date being its first
    moment; list, pattern and since are those of the longest pattern, ties going to the list that sorts first, and null if
    there is none. A null URL, one without a host, or a fetch time that is null or no time is not blocked. Very long URLs are judged whole.
    Repeated rows are each judged; no entries block nothing; an empty table gives no rows; as rows stay inside `row`, their
    names cannot clash.
    """
    rows = captures.select(F.struct(*[F.col(f"`{c}`") for c in captures.columns]).alias("row"), F.col(f"`{url}`").alias("url"), F.col(f"`{fetched}`").try_cast("timestamp").alias("at"))
    once = materialize(rows.where("url is not null and at is not null").groupBy("url", "at").agg(F.count("*").alias("n")), "url-fetches")
    # Only months in which something was fetched need entries.
    lo, hi = (F.lit(x).cast("timestamp") for x in once.agg(F.date_trunc("month", F.min("at")).cast("string"), F.max("at").cast("string")).first())
    spells = validity(entries).where((F.col("since") <= hi) & (F.col("until").isNull() | (F.col("until") > lo)))
    last = F.least(hi, F.coalesce("until", hi))
    # Prefixes go as deep as the deepest pattern.
    segments = spells.agg(F.max(F.length("pattern") - F.length(F.replace("pattern", F.lit("/"))))).first()[0] or 0
    keys = once.select("url", "at", F.trunc("at", "month").alias("month"), F.explode(covering_patterns(F.col("url"), segments)).alias("key"))
    spells = spells.withColumn("month", F.explode(F.sequence(F.trunc(F.greatest(F.col("since"), lo), "month"), F.trunc(last, "month"), F.expr("interval 1 month"))))
    spells = spells.select(F.col("pattern").alias("key"), "month", "list", "since", "until")
    met = materialize(keys.groupBy("key", "month").agg(F.count("*").alias("n")), "url-keys")
    busy = F.broadcast(_hot(met, "key", "month").withColumn("hot", F.lit(True)))
    keys = keys.join(busy, ["key", "month"], "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("url", "at"), F.lit(SALTS))).otherwise(F.lit(0).cast("bigint"))).drop("hot")
    salts = F.sequence(F.lit(0).cast("bigint"), F.when(F.col("hot"), F.lit(SALTS - 1)).otherwise(F.lit(0)).cast("bigint"))
    spells = spells.join(busy, ["key", "month"], "left").withColumn("salt", F.explode(salts)).drop("hot")
    active = keys.join(spells, ["key", "month", "salt"]).where("since <= at and (until is null or at < until)")
    best = F.min(F.struct((-F.length("key")).alias("short"), "list", "key", "since"))
    found = materialize(active.groupBy("url", "at").agg(F.count("*").alias("n_active"), best.alias("best")), "url-found").withColumnsRenamed({"url": "u", "at": "t"})
    same = (F.col("url") == F.col("u")) & (F.col("at") == F.col("t"))
    often = _hot(once, "url", "at").withColumnsRenamed({"url": "hu", "at": "ht"})
    if often.isEmpty():
        joined = rows.join(found, same, "left")
    else:  # Rows of a URL and time that many rows have meet a broadcast row; the rest is shuffled.
        apart = rows.join(F.broadcast(often.withColumn("hot", F.lit(True))), (F.col("url") == F.col("hu")) & (F.col("at") == F.col("ht")), "left").drop("hu", "ht")
        hot_found = found.join(F.broadcast(often), (F.col("u") == F.col("hu")) & (F.col("t") == F.col("ht")), "left_semi")
        joined = apart.where("hot").join(F.broadcast(hot_found), same, "left").unionByName(apart.where("hot is null").join(found, same, "left"))
    n = F.coalesce("n_active", F.lit(0)).cast("bigint")
    return joined.select("row", (n > 0).alias("blocked"), n.alias("n_active"), F.col("best.list").alias("list"), F.col("best.key").alias("pattern"), F.col("best.since").alias("since"))
