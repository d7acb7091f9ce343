"""Station search, resolution, and the stations that a user looked up last. A query set is stated by the caller; every
station row is tested against all of it in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headwind.functions import names

EARTH_KM = 6371.0
MOST_RECENT = 5


def distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Along a great circle, by the haversine formula."""
    a, b = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(F.pow(F.sin(a), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(b), 2))))


def _asked(stops: DataFrame, queries: list) -> DataFrame:
    return stops.withColumn("query", F.explode(F.array(*[F.lit(q) for q in queries])))


def search_by_name(stops: DataFrame, queries: list[str], limit: int = 10) -> DataFrame:
    """(query, position, stop, name, tier): stops whose name has the query in it, the best matches first."""
    queries = [q for q in queries if q.strip()]
    if not queries:
        return stops.select(F.lit("").alias("query"), F.lit(1).alias("position"), "stop", "name", F.lit(0).alias("tier")).limit(0)
    found = _asked(stops, queries).where(F.contains(F.lower("name"), F.lower(names.trimmed(F.col("query")))))
    found = found.withColumn("tier", names.match_tier(F.col("name"), F.col("query")))
    order = Window.partitionBy("query").orderBy("tier", "name", "stop")
    return found.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit).select("query", "position", "stop", "name", "tier")


def search_by_place(stops: DataFrame, points: list[tuple[float, float]], radius_km: float = 5.0, limit: int = 10) -> DataFrame:
    """(point, position, stop, metres): stops within the radius, nearest first; stops without a place are left out."""
    each = stops.withColumn("p", F.explode(F.array(*[F.struct(F.lit(i).alias("point"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, (a, b) in enumerate(points)])))
    near = each.withColumn("km", distance_km(F.col("p.a"), F.col("p.b"), F.col("lat"), F.col("lon"))).where(F.col("km") <= radius_km)
    metres = near.withColumn("metres", F.round(F.col("km") * 1000).cast("bigint"))
    order = Window.partitionBy("p.point").orderBy("metres", "stop")
    return metres.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit).select("p.point", "position", "stop", "metres")


def resolve(stops: DataFrame, arguments: list[str]) -> DataFrame:
    """(query, stop, way): the stop that an argument means - a source id, else a number of digits, else the best name."""
    arguments = [a for a in arguments if a and a.strip()]
    each = _asked(stops, arguments).withColumn("query", names.trimmed(F.col("query")))
    digits = F.when(F.col("query").rlike(r"^[0-9]+\z"), F.col("query").try_cast("bigint"))
    way = (
        F.when(F.col("source_stop_id") == F.col("query"), 0)
        .when(F.col("stop") == digits, 1)
        .when(F.contains(F.lower("name"), F.lower("query")), 2 + names.match_tier(F.col("name"), F.col("query")))
    )
    order = Window.partitionBy("query").orderBy("way", "name", "stop")
    best = each.withColumn("way", way).where("way is not null").withColumn("position", F.row_number().over(order)).where("position = 1")
    return best.select("query", "stop", F.when(F.col("way") == 0, "source").when(F.col("way") == 1, "number").otherwise("name").alias("way"))


def recent_stations(lookups: DataFrame, most: int = MOST_RECENT) -> DataFrame:
    """(user_id, position, station) of lookups (user_id, station, ts): the last ones, each once, newest first."""
    last = lookups.groupBy("user_id", "station").agg(F.max("ts").alias("ts"))
    order = Window.partitionBy("user_id").orderBy(F.desc("ts"), "station")
    return last.withColumn("position", F.row_number().over(order)).where(F.col("position") <= most).select("user_id", "position", "station")


def without_recent(suggestions: DataFrame, recents: DataFrame) -> DataFrame:
    """Suggestions (user_id, station) that are not among the user's recent stations."""
    return suggestions.join(recents.select("user_id", "station"), ["user_id", "station"], "left_anti")
