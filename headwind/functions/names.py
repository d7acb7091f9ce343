"""Names of lines, stations and modes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Categories whose number names a line; modes by route type; modes that stop at a track.
LINE_CATEGORIES = ("R", "RE", "S", "SN", "IR", "PE", "CC")
ROUTE_TYPES = ("TRAM", "SUBWAY", "RAIL", "BUS", "FERRY", "CABLE_TRAM", "AERIAL_LIFT", "FUNICULAR", "TROLLEYBUS", "MONORAIL")
TRACK_MODES = ("RAIL", "SUBWAY", "FUNICULAR")
# What parts the words of a station's name.
WORD_BREAKS = (" ", "\t", "\n", "\x0b", "\f", "\r", ",", "/", "-")
#: Counted up with every change of how lines are named, so that timetables named by older rules are built anew.
RULES = 2


def station_number(text: Column) -> Column:
    """The first seven characters as a number above 0, if all are digits; else null."""
    first = F.substring(text, 1, 7)
    number = F.when(first.rlike(r"^[0-9]+\z"), first.try_cast("int"))
    return F.when(number > 0, number)


def station_of_stop(stop_id: Column) -> Column:
    """The station number before the first colon of a stop id; null if it isn't digits."""
    first = F.split_part(stop_id, F.lit(":"), F.lit(1))
    return F.when(first.rlike(r"^[0-9]+\z"), first.try_cast("bigint"))


def trimmed(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, r"^[\s\p{Z}﻿]+|[\s\p{Z}﻿]+\z", "")


def category(line: Column) -> Column:
    """The letters of a name of letters and then digits, if any; null for every other name."""
    found = F.regexp_extract(line, r"^(\p{L}+)[0-9]*\z", 1)
    return F.when(found != "", found)


def numbered_prefix(line: Column) -> Column:
    """The letters before a name's first digit; null if it doesn't begin so."""
    found = F.regexp_extract(line, r"^(\p{L}+)[0-9]", 1)
    return F.when(found != "", found)


def full_line_name(short: Column, long: Column) -> Column:
    """Category and number where the long name has just these and the category names lines by number; else null."""
    short, long = trimmed(short), trimmed(long)
    number = F.regexp_extract(long, rf"^({'|'.join(LINE_CATEGORIES)}) ?([0-9]{{1,3}})\z", 2)
    prefix = F.regexp_extract(long, rf"^({'|'.join(LINE_CATEGORIES)}) ?([0-9]{{1,3}})\z", 1)
    return F.when((number != "") & (prefix == short), F.concat(short, number))


def route_type_name(number: Column) -> Column:
    """The mode of a route type; OTHER for those without a name."""
    names = F.create_map(*[x for i, n in enumerate(ROUTE_TYPES, 1) for x in (F.lit(i), F.lit(n))])
    return F.coalesce(F.try_element_at(names, number.cast("int")), F.lit("OTHER"))


def platform_word(mode: Column) -> Column:
    return F.when(mode.isin(*TRACK_MODES), "Gleis").otherwise("Kante")


def match_tier(name: Column, query: Column) -> Column:
    """How well a name answers a query: 0 is it, 1 begins with it, 2 has a word that does, 3 any other way."""
    name, query = F.lower(name), F.lower(trimmed(query))
    within = F.exists(F.array(*[F.lit(x) for x in WORD_BREAKS]), lambda x: F.contains(name, F.concat(x, query)))
    return F.when(name == query, 0).when(F.startswith(name, query), 1).when(within, 2).otherwise(3).cast("int")
