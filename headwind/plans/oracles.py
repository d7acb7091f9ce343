"""DuckDB SQL for the registered queries, written apart from the Spark code that it is held against."""

from __future__ import annotations

_EVENTS = """
e AS (SELECT *, CAST(json_extract(props, '$.k') AS INT) AS k, CASE WHEN hour(ts) < 4 AND event_id % 3 = 0 THEN 1 ELSE 0 END AS off FROM events)"""

_OBS = (
    _EVENTS
    + """,
obs AS (SELECT CAST(ts AS DATE) - off AS service_day, CAST(8500000 + user_id % 5 AS INT) AS bpuic, event_type AS line, CAST(hour(ts) * 60 + 30 AS INT) AS dep_min,
        CAST(off AS INT) AS day_offset, CAST(minute(ts) * 60 + second(ts) - 1800 AS INT) AS delay_s FROM e)"""
)

_MATCHED = (
    _EVENTS
    + """,
obs AS (SELECT CAST(ts AS DATE) - off AS service_day, CAST(8500000 + user_id % 100 AS INT) AS bpuic,
        CASE event_type WHEN 'view' THEN 'RE12' WHEN 'click' THEN 'RE' WHEN 'signup' THEN 'S3' WHEN 'error' THEN '9' ELSE 'IC' END AS line,
        CAST(hour(ts) * 60 + 30 AS INT) AS dep_min, CAST(off AS INT) AS day_offset, CAST(minute(ts) * 60 + second(ts) - 1800 AS INT) AS delay_s FROM e)"""
)

#: Easter by Gauss's rule of 1800 with his later correction: two remainders, and two exceptions.
_EASTER = """
years AS (SELECT CAST(y AS INT) AS y FROM range(1890, 2210) AS t(y)),
century AS (SELECT y, y // 100 - y // 400 - (8 * (y // 100) + 13) // 25 AS solar, y // 100 - y // 400 AS leap FROM years),
full_moon AS (SELECT y, solar, leap, (19 * (y % 19) + 15 + solar) % 30 AS moon FROM century),
week AS (SELECT *, (2 * (y % 4) + 4 * (y % 7) + 6 * moon + 4 + leap) % 7 AS ahead FROM full_moon),
easter AS (SELECT y, CAST(CASE WHEN moon = 29 AND ahead = 6 THEN make_date(y, 4, 19) WHEN moon = 28 AND ahead = 6 AND y % 19 > 10 THEN make_date(y, 4, 18)
           ELSE make_date(y, 3, 22) + CAST(moon + ahead AS INT) END AS DATE) AS sunday FROM week),
holiday AS (
  SELECT sunday - 2 AS day, 'Karfreitag' AS name, 2 AS pri FROM easter UNION ALL SELECT sunday + 1, 'Ostermontag', 2 FROM easter UNION ALL
  SELECT sunday + 39, 'Auffahrt', 2 FROM easter UNION ALL SELECT sunday + 50, 'Pfingstmontag', 2 FROM easter UNION ALL
  SELECT make_date(y, 1, 1), 'Neujahr', 1 FROM years UNION ALL SELECT make_date(y, 1, 2), 'Berchtoldstag', 1 FROM years UNION ALL
  SELECT make_date(y, 8, 1), 'Bundesfeier', 1 FROM years UNION ALL SELECT make_date(y, 12, 25), 'Weihnachten', 1 FROM years UNION ALL SELECT make_date(y, 12, 26), 'Stephanstag', 1 FROM years),
hol AS (SELECT day, arg_min(name, pri) AS holiday FROM holiday GROUP BY day)"""

_NAMES = "['monday','tuesday','wednesday','thursday','friday','saturday','sunday']"


def _day_type(day: str) -> str:
    return f"CAST(CASE WHEN {day} IN (SELECT day FROM hol) THEN 6 ELSE isodow({day}) - 1 END AS INT)"


_MEAN = "CAST(sign(sum(delay_s)) * ((2 * abs(sum(delay_s)) + count(*)) // (2 * count(*))) AS INT)"
_BUFFER = "list_sort(list(delay_s))[count(*) // 10 + 1]"


def _stats(obs: str, sets: str = "day, pool, 'all'", min_samples: int = 1, source: str = "obs") -> str:
    """WITH-list that ends in `stats`."""
    return f"""{obs}, {_EASTER},
typed AS (SELECT *, {_day_type('service_day')} AS day_type FROM {source}),
named AS (SELECT *, {_NAMES}[day_type + 1] AS day, CASE WHEN day_type < 5 THEN 'weekdays' ELSE 'weekend' END AS pool FROM typed),
each AS (SELECT *, unnest([{sets}]) AS delay_set FROM named),
grouped AS (SELECT delay_set, bpuic, line, dep_min, day_offset, count(*) AS samples, {_MEAN} AS avg_delay_s, {_BUFFER} AS catch_buffer_s FROM each GROUP BY ALL HAVING count(*) >= {min_samples}),
stats AS MATERIALIZED (SELECT * FROM grouped QUALIFY row_number() OVER (PARTITION BY delay_set, bpuic, line, dep_min ORDER BY samples DESC, abs(day_offset), day_offset) = 1)"""


_STATS_COLUMNS = "delay_set, bpuic, line, dep_min, catch_buffer_s, avg_delay_s, samples, day_offset"

_RAW = (
    _EVENTS
    + """,
r1 AS (SELECT *, strftime(ts, '%d.%m.%Y %H:30:00') AS planned, CAST(8500000 + user_id % 5 AS VARCHAR) || CASE WHEN event_id % 2 = 0 THEN '12' ELSE '' END AS number FROM e),
raw AS (SELECT strftime(CAST(ts AS DATE) - off, '%d.%m.%Y') AS day, CASE WHEN k = 7 THEN '  ' ELSE ' ' || event_type || '  ' END AS line,
        CASE WHEN k = 1 THEN 'TRUE' ELSE 'false' END AS extra, CASE WHEN k = 2 THEN 'true' ELSE '' END AS cancelled, CASE WHEN k = 3 THEN 'True' ELSE 'yes' END AS through,
        CASE WHEN k = 8 THEN '85x0001' WHEN k = 9 THEN '0' ELSE number END AS bpuic, CASE WHEN k = 10 THEN substr(planned, 1, 10) ELSE planned END AS planned,
        CASE WHEN k = 11 THEN '31.02.2024 10:00:00' WHEN k = 12 THEN strftime(ts + INTERVAL 3 DAY, '%d.%m.%Y %H:%M:%S') ELSE strftime(ts, '%d.%m.%Y %H:%M:%S') END AS actual,
        CASE WHEN k = 4 THEN '' WHEN k = 5 THEN 'Unbekannt' WHEN k = 6 THEN 'PROGNOSE' ELSE 'REAL' END AS status FROM r1),
p1 AS (SELECT *, trim(line, ' ') AS line_, CASE WHEN regexp_matches(substr(bpuic, 1, 7), '^[0-9]+$') AND CAST(substr(bpuic, 1, 7) AS INT) > 0 THEN CAST(substr(bpuic, 1, 7) AS INT) END AS bpuic_,
       try_strptime(planned, '%d.%m.%Y %H:%M:%S') AS planned_, try_strptime(actual, '%d.%m.%Y %H:%M:%S') AS actual_, CAST(try_strptime(day, '%d.%m.%Y') AS DATE) AS day_ FROM raw),
p2 AS (SELECT *, epoch(actual_) - epoch(planned_) AS delay, CAST(planned_ AS DATE) - day_ AS offset_ FROM p1),
p AS (SELECT *, CASE WHEN lower(extra) = 'true' OR lower(cancelled) = 'true' OR lower(through) = 'true' THEN 'flag' WHEN status = '' OR lower(status) = 'unbekannt' THEN 'status'
      WHEN line_ = '' THEN 'line' WHEN bpuic_ IS NULL THEN 'station' WHEN planned_ IS NULL OR actual_ IS NULL THEN 'stamp' WHEN delay NOT BETWEEN -86400 AND 86400 THEN 'delay'
      WHEN day_ IS NULL OR offset_ NOT BETWEEN -1 AND 1 THEN 'service_day' END AS reason FROM p2)"""
)

_TIMES = """
t0 AS (SELECT l_orderkey, l_suppkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS INT) AS seq,
       CAST(count(*) OVER (PARTITION BY l_orderkey) AS INT) AS n_stops FROM lineitem),
times AS MATERIALIZED (SELECT CAST(isodow(CAST(o_orderdate AS DATE)) - 1 AS INT) AS day_type, l_orderkey AS trip, seq, n_stops, CAST(8500000 + l_suppkey AS INT) AS stop,
          ['RE12','RE','RE5','S3','9','IC21','S'][o_orderkey % 7 + 1] AS line, CAST(30 + 60 * ((o_orderkey * 5) % 24) + 60 * (seq - 1) AS INT) AS dep FROM t0 JOIN orders ON l_orderkey = o_orderkey)"""

_SHOWN = "anchor, query_day, \"offset\", day_type, trip, seq, stop, line, dep, clock, destination"


def _board(times: tuple[int, ...], tail: str = "at_ < 360", limit: int = 12) -> str:
    """WITH-list that ends in `found`."""
    return f"""{_TIMES},
ends AS (SELECT day_type, trip, stop AS destination FROM times WHERE seq = n_stops),
dep0 AS (SELECT times.*, destination FROM times JOIN ends USING (day_type, trip) WHERE seq < n_stops),
segs AS (SELECT *, day_type AS query_day, 0 AS "offset", dep AS clock FROM dep0 UNION ALL SELECT *, (day_type + 1) % 7, 1440, dep - 1440 FROM dep0 WHERE dep >= 1440),
anchors AS (SELECT CAST((s_suppkey * 7 + d) * {len(times)} + i AS INT) AS anchor, CAST(8500000 + s_suppkey AS INT) AS stop, CAST(d AS INT) AS query_day, {list(times)}[i + 1] AS at_, {limit} AS "limit"
            FROM supplier, range(0, 7) AS a(d), range(0, {len(times)}) AS b(i)),
found AS MATERIALIZED (SELECT segs.*, anchor, at_, "limit" FROM segs JOIN anchors USING (stop, query_day) WHERE "offset" = 0 OR {tail})"""


def _page(where: str, order: str, limit: str = '"limit"', source: str = "found") -> str:
    return f'SELECT * FROM {source} WHERE {where} QUALIFY rank() OVER (PARTITION BY anchor ORDER BY clock {order}) <= {limit}'


_LATER, _EARLIER = _page("clock >= at_", "ASC"), _page("clock < at_", "DESC")
_AROUND = f"{_EARLIER} UNION ALL SELECT * FROM found WHERE clock = at_ UNION ALL {_page('clock > at_', 'ASC')}"


def _category(x: str) -> str:
    return f"nullif(regexp_extract({x}, '^(\\p{{L}}+)\\d*$', 1), '')"


def _enriched(board: str | None = None, page: str = _LATER, station: str = "stop") -> str:
    """WITH-list that ends in `rows`: a page's rows for each scope with the statistics that they get."""
    return f"""{_stats(_MATCHED)}, {board or _board((15,))},
page AS MATERIALIZED ({page}),
scoped AS MATERIALIZED (SELECT page.*, CAST(dep % 1440 AS INT) AS minute, {_category('line')} AS category, s.scope,
           CASE s.scope WHEN 'day' THEN {_NAMES}[day_type + 1] WHEN 'group' THEN CASE WHEN day_type < 5 THEN 'weekdays' ELSE 'weekend' END ELSE 'all' END AS wanted
           FROM page, (SELECT unnest(['day', 'group', 'all']) AS scope) AS s),
others AS (SELECT DISTINCT a.anchor, a."offset", a.minute, a.line FROM scoped AS a JOIN scoped AS b ON a.anchor = b.anchor AND a."offset" = b."offset" AND a.minute = b.minute AND a.line <> b.line AND a.category = b.category),
numbered AS (SELECT s.anchor, s.trip, s.seq, s."offset", s.scope, min(st.line) AS line, count(*) AS n FROM scoped AS s JOIN stats AS st ON st.bpuic = s.{station} AND st.dep_min = s.minute AND st.delay_set = s.wanted
             AND regexp_extract(st.line, '^(\\p{{L}}+)\\d', 1) = s.category
             WHERE NOT EXISTS (SELECT 1 FROM scoped AS o WHERE o.anchor = s.anchor AND o."offset" = s."offset" AND o.minute = s.minute AND o.line = st.line) GROUP BY ALL),
chosen AS (SELECT s.*, CASE WHEN x.line IS NOT NULL THEN 'exact' WHEN s.category IS NULL THEN 'none' WHEN s.category <> s.line AND o.line IS NULL AND c.line IS NOT NULL THEN 'category'
           WHEN s.category = s.line AND n.n = 1 THEN 'number' ELSE 'none' END AS kind, n.line AS numbered_line
           FROM scoped AS s LEFT JOIN stats AS x ON x.bpuic = s.{station} AND x.dep_min = s.minute AND x.delay_set = s.wanted AND x.line = s.line
           LEFT JOIN stats AS c ON c.bpuic = s.{station} AND c.dep_min = s.minute AND c.delay_set = s.wanted AND c.line = s.category
           LEFT JOIN others AS o ON o.anchor = s.anchor AND o."offset" = s."offset" AND o.minute = s.minute AND o.line = s.line
           LEFT JOIN numbered AS n ON n.anchor = s.anchor AND n.trip = s.trip AND n.seq = s.seq AND n."offset" = s."offset" AND n.scope = s.scope),
rows AS (SELECT h.*, st.line AS matched, st.catch_buffer_s, st.avg_delay_s, st.samples FROM chosen AS h LEFT JOIN stats AS st
         ON st.bpuic = h.{station} AND st.dep_min = h.minute AND st.delay_set = h.wanted AND st.line = CASE h.kind WHEN 'exact' THEN h.line WHEN 'category' THEN h.category WHEN 'number' THEN h.numbered_line END)"""


def _asked() -> str:
    """WITH-list that ends in `found`: the departures of five board requests; Saturday has no timetable here."""
    own = _board((15,))
    return f"{own[:own.index('anchors AS (')].rstrip().rstrip(',')}, {_STOPS}, {_ASKED.format(tier=_tier('name', 'a.query'))}"


def _rolled() -> str:
    """Later pages from 23:00 to 26:00; where one is empty, the next day's, a day's minutes earlier."""
    first = _board((1380, 1439, 1500))
    next_day = """later AS (SELECT CAST((query_day + 1) % 7 AS INT) AS query_day, CAST(greatest(0, at_ - 1440) AS INT) AS at_, anchor, stop, "limit" FROM anchors WHERE anchor NOT IN (SELECT anchor FROM page)),
again AS (SELECT segs.*, anchor, at_, "limit" FROM segs JOIN later USING (stop, query_day) WHERE "offset" = 0 OR at_ < 360)"""
    return f"WITH {first}, page AS MATERIALIZED ({_LATER}), {next_day} SELECT {_SHOWN}, 0 AS rolled FROM page UNION ALL SELECT {_SHOWN}, 1 FROM ({_page('clock >= at_', 'ASC', source='again')})"


def _clock_s(x: str) -> str:
    s = f"((({x}) % 86400 + 86400) % 86400)"
    return f"printf('%02d:%02d:%02d', {s} // 3600, {s} % 3600 // 60, {s} % 60)"


def _delay_text(x: str) -> str:
    amount = f"CASE WHEN abs({x}) >= 60 THEN printf('%dm %ds', abs({x}) // 60, abs({x}) % 60) ELSE printf('%ds', abs({x})) END"
    return f"CASE WHEN {x} > 0 THEN '+' || {amount} || ' late' WHEN {x} < 0 THEN '-' || {amount} || ' early' WHEN {x} = 0 THEN 'on time' END"


def _duration(x: str) -> str:
    return f"CASE WHEN {x} >= 60 AND {x} % 60 > 0 THEN printf('%d Min %d Sek', {x} // 60, {x} % 60) WHEN {x} >= 60 THEN printf('%d Min', {x} // 60) ELSE printf('%d Sek', {x}) END"


def _tick(x: str) -> str:
    return f"CASE WHEN {x} BETWEEN 0 AND 60 THEN printf(':%02d', {x}) ELSE CASE WHEN {x} < 0 THEN '−' ELSE '' END || printf('%d:%02d', abs({x}) // 60, abs({x}) % 60) END"


def _seconds(x: str, plus: str) -> str:
    return f"CASE WHEN {x} < 0 THEN '−' WHEN {x} > 0 THEN '{plus}' ELSE '' END || CASE WHEN abs({x}) < 60 THEN printf('%d s', abs({x})) ELSE printf('%d:%02d', abs({x}) // 60, abs({x}) % 60) END"


_WIDE = _OBS + ", wide AS (SELECT * REPLACE (CAST(delay_s * 40 AS INT) AS delay_s) FROM obs)"
_CLAMP = """shards AS (SELECT delay_set, bpuic, line, dep_min, CAST(greatest(-32768, least(32767, catch_buffer_s)) AS INT) AS catch_buffer_s, CAST(greatest(-32768, least(32767, avg_delay_s)) AS INT) AS avg_delay_s,
            CAST(least(255, samples) AS INT) AS samples, day_offset, catch_buffer_s NOT BETWEEN -32768 AND 32767 OR avg_delay_s NOT BETWEEN -32768 AND 32767 AS clamped, CAST(bpuic % 1024 AS INT) AS bucket FROM stats)"""
_DAYS_2026 = "SELECT CAST(d AS DATE) AS today FROM range(DATE '{0}', DATE '{1}' + 1, INTERVAL 1 DAY) AS t(d)"
_STOPS = """
stops AS (SELECT CAST(8500000 + s_suppkey AS BIGINT) AS stop, CAST(8500000 + s_suppkey AS VARCHAR) || ':0:' || CAST(s_suppkey % 4 AS VARCHAR) AS source_stop_id, n_name || ' ' || s_name AS name,
          CASE WHEN s_suppkey % 4 <> 0 THEN 8500000 + s_suppkey - s_suppkey % 4 END AS parent, CAST(46 + (s_suppkey * 37 % 100) / 100.0 AS DOUBLE) AS lat, CAST(7 + (s_suppkey * 53 % 200) / 100.0 AS DOUBLE) AS lon
          FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


def _tier(name: str, query: str) -> str:
    q = f"lower(trim({query}))"
    within = f"list_bool_or(list_transform([' ', ',', '/', '-', chr(9), chr(10), chr(11), chr(12), chr(13)], lambda x: contains(lower({name}), x || {q})))"
    return f"CAST(CASE WHEN lower({name}) = {q} THEN 0 WHEN starts_with(lower({name}), {q}) THEN 1 WHEN {within} THEN 2 ELSE 3 END AS INT)"


_LOOKUPS = """
looked AS (SELECT user_id, CAST(8500000 + CAST(json_extract(props, '$.k') AS INT) % 20 AS INT) AS station, max(ts) AS ts FROM events GROUP BY ALL),
recent AS (SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, station) AS INT) AS position, station FROM looked QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, station) <= 5)"""

_COVER = f"""{_OBS}, {_EASTER}, days AS (SELECT DISTINCT service_day, {_day_type('service_day')} AS day_type FROM obs),
cover AS (SELECT unnest([{_NAMES}[day_type + 1], CASE WHEN day_type < 5 THEN 'weekdays' ELSE 'weekend' END, 'all']) AS delay_set, service_day FROM days),
coverage AS (SELECT delay_set, count(*) AS days FROM cover GROUP BY 1)"""
#: Eight bundles: number k lacks the days whose number in the week has a bit in common with k.
_SERVED = f"""{_OBS}, {_EASTER}, days AS (SELECT DISTINCT {_day_type('service_day')} AS day_type FROM obs),
kept AS (SELECT CAST(b AS INT) AS bundle, day_type FROM days, range(0, 8) AS r(b) WHERE CAST(b AS INT) & day_type = 0),
served AS (SELECT DISTINCT bundle, unnest([{_NAMES}[day_type + 1], CASE WHEN day_type < 5 THEN 'weekdays' ELSE 'weekend' END, 'all']) AS delay_set FROM kept)"""

_ASKED = """
asks AS (SELECT * FROM (VALUES (0, '8500004:0:0', 2, 15, 5), (1, '8500007', 6, 480, 3), (2, 'russia', 0, 1200, 4), (3, 'nowhere', 0, 15, 4), (4, 'Supplier#000000003', 5, 1439, 12)) AS v(anchor, query, day_type, at_, "limit")),
origins AS (SELECT query, stop FROM (SELECT a.query, s.stop, name, CASE WHEN source_stop_id = a.query THEN 0 WHEN CAST(s.stop AS VARCHAR) = a.query THEN 1 WHEN contains(lower(name), lower(a.query)) THEN 2 + {tier} END AS way
            FROM asks AS a, stops AS s) WHERE way IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query ORDER BY way, name, stop) = 1),
types AS (SELECT DISTINCT day_type FROM dep0 WHERE day_type <> 5),
anchors AS (SELECT CAST(a.anchor AS INT) AS anchor, o.stop AS origin, CAST(b.stop AS INT) AS stop, CAST(coalesce(p.stop, s.stop) AS BIGINT) AS station,
            CASE WHEN a.day_type IN (SELECT day_type FROM types) THEN a.day_type ELSE (SELECT min(day_type) FROM types) END AS query_day, a.day_type IN (SELECT day_type FROM types) AS own, at_, "limit"
            FROM asks AS a JOIN origins AS o USING (query) JOIN stops AS s ON s.stop = o.stop JOIN stops AS b ON coalesce(b.parent, b.stop) = coalesce(s.parent, s.stop) LEFT JOIN stops AS p ON p.stop = s.parent),
found AS MATERIALIZED (SELECT segs.*, anchor, origin, station, own, at_, "limit" FROM segs JOIN anchors USING (stop, query_day) WHERE day_type <> 5 AND ("offset" = 0 OR at_ < 360))"""


def oracles() -> dict[str, str]:
    out = {
        "obs_parse_filter": f"WITH {_RAW} SELECT CAST(day_ AS VARCHAR) AS service_day, bpuic_ AS bpuic, line_ AS line, CAST(hour(planned_) * 60 + minute(planned_) AS INT) AS dep_min, CAST(offset_ AS INT) AS day_offset, CAST(delay AS INT) AS delay_s FROM p WHERE reason IS NULL",
        "obs_drop_reasons": f"WITH {_RAW} SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM p GROUP BY 1",
        "station_truncate": f"WITH {_RAW} SELECT bpuic AS raw, bpuic_ AS bpuic, CASE WHEN regexp_matches(bpuic, '^[0-9]+$') THEN CAST(bpuic AS BIGINT) END AS stop_number, count(*) AS n FROM p GROUP BY ALL",
        "service_groups": f"WITH {_OBS} SELECT bpuic, line, dep_min, day_offset, count(*) AS samples, CAST(sum(delay_s) AS BIGINT) AS total_delay_s FROM obs GROUP BY ALL",
        "service_stats_day": f"WITH {_stats(_OBS, 'day')} SELECT {_STATS_COLUMNS} FROM stats",
        "service_stats_sets": f"WITH {_stats(_OBS)} SELECT {_STATS_COLUMNS} FROM stats",
        "service_stats_min_samples": f"WITH {_stats(_OBS, min_samples=3)} SELECT {_STATS_COLUMNS} FROM stats",
        "service_stats_allowed": f"WITH {_stats(_OBS)} SELECT {_STATS_COLUMNS} FROM stats WHERE bpuic IN (SELECT 8500000 + s_suppkey FROM supplier WHERE s_acctbal > 4000)",
        "service_histogram_p10": f"WITH {_OBS} SELECT bpuic, line, count(*) AS samples, {_MEAN} AS avg_delay_s, {_BUFFER} AS catch_buffer_s FROM obs GROUP BY ALL",
        "order_delay_stats": f"WITH o AS (SELECT CAST(8500000 + l_suppkey % 10 AS INT) AS bpuic, l_returnflag || l_linestatus AS line, CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS INT) AS delay_s FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT bpuic, line, count(*) AS samples, {_MEAN} AS avg_delay_s, {_BUFFER} AS catch_buffer_s FROM o GROUP BY ALL",
        "ignored_lines": f"WITH {_OBS} SELECT line, count(*) AS n FROM obs WHERE line NOT IN (SELECT line FROM obs WHERE service_day < DATE '2024-01-15' AND line <> 'error') GROUP BY 1",
        "shard_rows": f"WITH {_stats(_WIDE, source='wide')}, {_CLAMP} SELECT * FROM shards",
        "stored_statistics": f"WITH {_stats(_OBS)}, {_CLAMP} SELECT * FROM shards",
        "feed_times": f"WITH {_TIMES}, kept AS (SELECT * FROM times WHERE (trip + seq) % 11 <> 0), days AS (SELECT CAST(d AS INT) AS on_day, CASE WHEN d = 2 THEN 0 ELSE d END AS day_type FROM range(0, 7) AS r(d)) SELECT on_day AS day_type, CAST(trip AS VARCHAR) AS trip, CAST(row_number() OVER (PARTITION BY on_day, trip ORDER BY seq) AS INT) AS seq, CAST(count(*) OVER (PARTITION BY on_day, trip) AS INT) AS n_stops, CAST(stop AS VARCHAR) AS stop, ['RE12', 'RE', 'RE5', 'S3', '9', 'IC', 'S'][trip % 7 + 1] AS line, dep, CAST(trip % 7 % 4 AS INT) AS route_type FROM kept JOIN days USING (day_type)",
        "run_totals": f"WITH {_stats(_WIDE, source='wide')}, {_CLAMP} SELECT delay_set, count(*) AS services, CAST(sum(samples) AS BIGINT) AS samples, count(*) FILTER (clamped) AS clamped, count(DISTINCT bpuic) AS stations, count(DISTINCT bucket) AS buckets FROM shards GROUP BY 1",
        "coverage_days": f"WITH {_COVER} SELECT * FROM coverage",
        "distinct_stations": f"WITH {_OBS} SELECT count(DISTINCT bpuic) AS stations FROM obs",
        "line_table": f"WITH {_OBS} SELECT DISTINCT line FROM obs",
        "first_days": f"WITH {_stats(_OBS + ', early AS (SELECT * FROM obs WHERE service_day IN (SELECT DISTINCT service_day FROM obs ORDER BY 1 LIMIT 3))', 'day', source='early')} SELECT {_STATS_COLUMNS} FROM stats",
        "calendar_day_types": f"WITH {_EASTER}, d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), t AS (SELECT day, {_day_type('day')} AS day_type FROM d) SELECT CAST(t.day AS VARCHAR) AS day, day_type, {_NAMES}[day_type + 1] AS name, CASE WHEN day_type < 5 THEN 'weekdays' ELSE 'weekend' END AS pool, holiday FROM t LEFT JOIN hol ON hol.day = t.day",
        "holidays": f"WITH {_EASTER} SELECT CAST(day AS VARCHAR) AS day, holiday FROM hol WHERE year(day) BETWEEN 2020 AND 2035",
        "easter": f"WITH {_EASTER} SELECT y AS year, CAST(sunday AS VARCHAR) AS easter FROM easter WHERE y BETWEEN 1900 AND 2199",
        "epoch_days": "SELECT DISTINCT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS INT) AS number FROM orders",
        "timetable_dates": f"WITH {_EASTER}, d AS ({_DAYS_2026.format('2026-01-01', '2026-12-31')}), c AS (SELECT today, w AS day_type, CAST((w - (isodow(today) - 1) + 7) % 7 + 7 * k AS INT) AS off FROM d, range(0, 7) AS a(w), range(-3, 4) AS b(k)), x AS (SELECT today, CAST(day_type AS INT) AS day_type, off, today + off AS date FROM c) SELECT CAST(today AS VARCHAR) AS today, day_type, CAST(date AS VARCHAR) AS date FROM x WHERE date BETWEEN DATE '2025-12-14' AND DATE '2026-12-12' QUALIFY row_number() OVER (PARTITION BY today, day_type ORDER BY CASE WHEN date IN (SELECT day FROM hol) THEN 1 ELSE 0 END, abs(off), off DESC) = 1",
        "month_window": f"WITH d AS ({_DAYS_2026.format('2026-01-01', '2026-12-31')}) SELECT CAST(today AS VARCHAR) AS day, CAST(CAST(date_trunc('month', today) - to_months(CAST(k AS INT)) AS DATE) AS VARCHAR) AS month FROM d, range(1, 13) AS r(k)",
        "next_date_of_day_type": f"WITH {_EASTER}, d AS ({_DAYS_2026.format('2026-03-01', '2026-06-30')}), q AS (SELECT today, CAST(w AS INT) AS wanted, CAST(today + CAST(w * 5 - 8 AS INT) AS DATE) AS shared FROM d, range(0, 7) AS r(w)), f AS (SELECT CAST(x AS DATE) AS day, {_day_type('CAST(x AS DATE)')} AS t FROM range(DATE '2026-02-01', DATE '2026-08-01', INTERVAL 1 DAY) AS z(x)), n AS (SELECT q.*, coalesce((SELECT min(day) FROM f WHERE t = wanted AND day BETWEEN today AND today + 6), today) AS next, coalesce((SELECT min(g.day) FROM f AS g WHERE g.t = (SELECT h.t FROM f AS h WHERE h.day = shared) AND g.day BETWEEN today AND today + 6), today) AS rolled FROM q) SELECT CAST(today AS VARCHAR) AS today, wanted, CAST(next AS VARCHAR) AS next, CAST(CASE WHEN shared BETWEEN today AND today + 14 THEN shared ELSE rolled END AS VARCHAR) AS linked FROM n",
        "date_window": f"WITH d AS ({_DAYS_2026.format('2026-03-01', '2026-03-31')}) SELECT CAST(today AS VARCHAR) AS today, CAST(today + CAST(k AS INT) AS VARCHAR) AS date, k BETWEEN 0 AND 14 AS ok FROM d, range(-3, 18) AS r(k)",
        "line_full_name": "WITH a AS (SELECT p_partkey, ['RE', 'S', 'EC', ' IR ', 'R', 'CC'][p_partkey % 6 + 1] AS short, CAST((p_partkey * 7) % 1300 AS VARCHAR) AS n FROM part), b AS (SELECT *, trim(short) AS c FROM a), f AS (SELECT p_partkey, short, c, [c || ' ' || n, c || n, 'N' || n, c || '  ' || n, 'RE ' || n][p_partkey % 5 + 1] AS long FROM b) SELECT p_partkey, short, long, CASE WHEN c IN ('R', 'RE', 'S', 'SN', 'IR', 'PE', 'CC') AND regexp_matches(long, '^' || c || ' ?[0-9]{1,3}$') THEN c || regexp_extract(long, '([0-9]+)$', 1) END AS line FROM f",
        "stop_patterns": f"WITH {_TIMES}, t AS (SELECT day_type, trip, line, list(stop ORDER BY seq) AS s FROM times GROUP BY ALL) SELECT day_type, line, array_to_string(s, ',') AS stops, s[1] AS first_stop, s[-1] AS last_stop, count(*) AS trips FROM t GROUP BY ALL",
        "trip_tail": f"WITH {_TIMES} SELECT * FROM times WHERE (day_type, trip) IN (SELECT (day_type, trip) FROM times WHERE seq < n_stops AND dep >= 1440)",
        "trip_destinations": f"WITH {_board((15,))} SELECT line, stop, destination, count(*) AS n, min(dep) AS first FROM dep0 GROUP BY ALL",
        "route_type_label": "WITH o AS (SELECT CAST(o_orderkey % 14 AS INT) AS route_type, count(*) AS n FROM orders GROUP BY 1), m AS (SELECT *, CASE WHEN route_type BETWEEN 1 AND 10 THEN ['TRAM', 'SUBWAY', 'RAIL', 'BUS', 'FERRY', 'CABLE_TRAM', 'AERIAL_LIFT', 'FUNICULAR', 'TROLLEYBUS', 'MONORAIL'][route_type] ELSE 'OTHER' END AS mode FROM o) SELECT *, CASE WHEN mode IN ('RAIL', 'SUBWAY', 'FUNICULAR') THEN 'Gleis' ELSE 'Kante' END AS platform FROM m",
        "departures_later": f"WITH {_board((15, 500, 1200))} SELECT {_SHOWN} FROM ({_LATER})",
        "departures_earlier": f"WITH {_board((15, 500, 1200))} SELECT {_SHOWN} FROM ({_EARLIER})",
        "departures_around": f"WITH {_board((30, 510, 1230))} SELECT {_SHOWN} FROM ({_AROUND})",
        "next_departure": f"WITH {_board((15, 500, 1200))} SELECT {_SHOWN} FROM ({_page('clock >= at_', 'ASC', '1')})",
        "earlier_with_tail": f"WITH {_board((300, 365, 500), tail='true')}, plain AS ({_page('clock < at_', 'DESC', source='(SELECT * FROM found WHERE ' + chr(34) + 'offset' + chr(34) + ' = 0 OR at_ < 360)')}), low AS (SELECT anchors.anchor FROM anchors LEFT JOIN plain USING (anchor) GROUP BY anchors.anchor, anchors.at_ HAVING anchors.at_ >= 360 AND coalesce(min(plain.clock), 0) < 360), whole AS ({_page('clock < at_', 'DESC')}) SELECT {_SHOWN} FROM plain WHERE anchor NOT IN (SELECT anchor FROM low) UNION ALL SELECT {_SHOWN} FROM whole WHERE anchor IN (SELECT anchor FROM low)",
        "segment_selection": f'WITH {_board((15, 359, 360))} SELECT anchor, at_ AS "at", query_day, "offset", count(*) AS n, min(clock) AS first, max(clock) AS last FROM found GROUP BY ALL',
        "shared_minute": f"WITH {_board((15, 500))}, page AS ({_LATER}) SELECT anchor, trip, seq, clock, count(*) OVER (PARTITION BY anchor, clock) > 1 AS shared FROM page",
        "page_extremes": f"WITH {_board((30, 510))}, page AS ({_AROUND}) SELECT anchor, min(clock) AS earliest, max(clock) AS latest, count(*) AS n FROM page GROUP BY 1",
        "page_dedupe": f"WITH {_board((510, 720))}, page AS (SELECT * REPLACE (anchor // 2 AS anchor) FROM ({_LATER})) SELECT CAST(anchor AS INT) AS anchor, stop, query_day, trip, seq, clock, line, destination FROM page AS f WHERE at_ = 720 AND NOT EXISTS (SELECT 1 FROM page AS s WHERE s.at_ = 510 AND s.anchor = f.anchor AND s.clock = f.clock AND s.line = f.line AND s.destination = f.destination)",
        "departures_with_delays": f'WITH {_enriched()} SELECT anchor, "offset", trip, seq, line, dep, clock, matched, catch_buffer_s, avg_delay_s, samples FROM rows WHERE scope = \'day\'',
        "departure_board": f'WITH {_enriched(_asked(), station="station")} SELECT anchor, origin, query_day, own, station AS station_number, stop, "offset", trip, seq, line, clock, destination, kind, matched, catch_buffer_s, samples FROM rows WHERE scope = \'all\'',
        "departures_rolled": _rolled(),
        "stop_event_files": f"WITH {_RAW} SELECT CAST(day_ AS VARCHAR) AS service_day, bpuic_ AS bpuic, line_ AS line, CAST(hour(planned_) * 60 + minute(planned_) AS INT) AS dep_min, CAST(offset_ AS INT) AS day_offset, CAST(delay AS INT) AS delay_s FROM p WHERE reason IS NULL",
        "departure_match_kind": f'WITH {_enriched()} SELECT kind, "offset", count(*) AS n FROM rows WHERE scope = \'group\' GROUP BY ALL',
        "departures_scopes": f'WITH {_enriched()} SELECT anchor, "offset", trip, seq, ' + ", ".join(f"max({c}) FILTER (scope = '{s}') AS {s}_{c}" for s in ("day", "group", "all") for c in ("kind", "catch_buffer_s", "samples")) + " FROM rows GROUP BY ALL",
        "departure_timing": f'WITH {_enriched()} SELECT anchor, "offset", trip, seq, printf(\'%02d:%02d\', dep % 1440 // 60, dep % 60) AS planned, CASE WHEN avg_delay_s IS NOT NULL THEN {_clock_s("dep % 1440 * 60 + avg_delay_s")} END AS actual, {_delay_text("avg_delay_s")} AS delay, CASE WHEN catch_buffer_s IS NOT NULL THEN {_clock_s("dep % 1440 * 60 + catch_buffer_s")} END AS latest, CASE WHEN catch_buffer_s < 0 THEN {_duration("(-catch_buffer_s)")} END AS before_plan FROM rows WHERE scope = \'all\'',
        "scopes_offered": f"WITH {_SERVED}, w AS (SELECT CAST(d AS INT) AS day_type, CAST(b AS INT) AS bundle, s.scope, CASE s.scope WHEN 'day' THEN {_NAMES}[d + 1] WHEN 'group' THEN CASE WHEN d < 5 THEN 'weekdays' ELSE 'weekend' END ELSE 'all' END AS delay_set FROM range(0, 7) AS r(d), range(0, 8) AS q(b), (SELECT unnest(['day', 'group', 'all']) AS scope) AS s) SELECT bundle, day_type, scope, (bundle, delay_set) IN (SELECT (bundle, delay_set) FROM served) AS offered FROM w",
        "day_type_resolution": f"WITH {_SERVED}, w AS (SELECT CAST(d AS INT) AS asked, CAST(b AS INT) AS bundle, {_NAMES}[d + 1] AS name FROM range(0, 7) AS r(d), range(0, 8) AS q(b)), f AS (SELECT bundle, arg_min(name, asked) AS first FROM w WHERE (bundle, name) IN (SELECT (bundle, delay_set) FROM served) GROUP BY 1) SELECT w.bundle, asked, CASE WHEN (w.bundle, name) IN (SELECT (bundle, delay_set) FROM served) THEN name ELSE first END AS answers, (w.bundle, name) IN (SELECT (bundle, delay_set) FROM served) AS statistics FROM w LEFT JOIN f ON f.bundle = w.bundle",
        "board_stops": f"WITH {_STOPS}, k AS (SELECT stop, coalesce(parent, stop) AS station FROM stops) SELECT a.stop, b.stop AS board_stop, CASE WHEN p.stop IS NOT NULL THEN p.stop ELSE a.stop END AS station_number FROM k AS a JOIN k AS b USING (station) JOIN stops AS s ON s.stop = a.stop LEFT JOIN stops AS p ON p.stop = s.parent",
        "station_search_rank": f"WITH {_STOPS}, q AS (SELECT unnest(['united', 'Supplier#0', 'king', ' RUSSIA ', 'an', 'i']) AS query), m AS (SELECT query, stop, name, {_tier('name', 'query')} AS tier FROM stops, q WHERE contains(lower(name), lower(trim(query)))) SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY tier, name, stop) AS INT) AS position, stop, name, tier FROM m QUALIFY row_number() OVER (PARTITION BY query ORDER BY tier, name, stop) <= 8",
        "station_nearest": f"WITH {_STOPS}, q AS (SELECT * FROM (VALUES (0, 46.5::DOUBLE, 8.0::DOUBLE), (1, 46.02::DOUBLE, 7.51::DOUBLE), (2, 46.9::DOUBLE, 8.9::DOUBLE)) AS v(point, a, b)), m AS (SELECT point, stop, 2 * 6371 * asin(least(1.0, sqrt(power(sin(radians(lat - a) / 2), 2) + cos(radians(a)) * cos(radians(lat)) * power(sin(radians(lon - b) / 2), 2)))) AS km FROM stops, q), r AS (SELECT point, stop, CAST(round(km * 1000) AS BIGINT) AS metres FROM m WHERE km <= 30) SELECT point, CAST(row_number() OVER (PARTITION BY point ORDER BY metres, stop) AS INT) AS position, stop, metres FROM r QUALIFY row_number() OVER (PARTITION BY point ORDER BY metres, stop) <= 10",
        "station_resolve": f"WITH {_STOPS}, q AS (SELECT unnest(['8500004:0:0', '8500007', 'russia', 'Supplier#000000003', 'nowhere', '8500004:0:3']) AS query), m AS (SELECT query, stop, name, CASE WHEN source_stop_id = query THEN 0 WHEN CAST(stop AS VARCHAR) = query THEN 1 WHEN contains(lower(name), lower(query)) THEN 2 + {_tier('name', 'query')} END AS way FROM stops, q) SELECT query, stop, CASE way WHEN 0 THEN 'source' WHEN 1 THEN 'number' ELSE 'name' END AS way FROM m WHERE way IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query ORDER BY m.way, name, stop) = 1",
        "recent_stations": f"WITH {_LOOKUPS} SELECT user_id, position, station FROM recent",
        "suggestion_dedupe": f"WITH {_LOOKUPS}, asked AS (SELECT DISTINCT user_id, CAST(8500000 + event_id % 20 AS INT) AS station FROM events) SELECT user_id, station FROM asked WHERE (user_id, station) NOT IN (SELECT (user_id, station) FROM recent)",
        "timeline_bounds": f"WITH {_stats(_OBS)}, b AS (SELECT *, CAST(least(0, floor(avg_delay_s / 30) * 30, floor(catch_buffer_s / 30) * 30) AS INT) AS lo, CAST(greatest(60, ceil(avg_delay_s / 30) * 30, ceil(catch_buffer_s / 30) * 30) AS INT) AS hi FROM stats) SELECT delay_set, bpuic, line, dep_min, lo, hi, {_tick('lo')} AS lo_text, {_tick('hi')} AS hi_text, CAST(floor((catch_buffer_s - lo) * 100000 / (hi - lo)) AS INT) AS buffer_pos FROM b",
        "delay_format": f"WITH {_OBS}, d AS (SELECT DISTINCT delay_s FROM obs) SELECT delay_s, {_delay_text('delay_s')} AS text, {_seconds('delay_s', '')} AS seconds, {_seconds('delay_s', '+')} AS signed, {_duration('abs(delay_s)')} AS duration, {_tick('delay_s')} AS tick FROM d",
        "clock_roundtrip": f"SELECT CAST(m AS INT) AS minute, printf('%02d:%02d', m % 1440 // 60, m % 60) AS clock, CAST(m AS INT) AS back, {_clock_s('m * 61 - 5000')} AS seconds, CAST(DATE '2026-12-30' + CAST(m // 1440 AS INT) AS VARCHAR) AS date FROM range(0, 3000, 7) AS t(m)",
    }
    return out
