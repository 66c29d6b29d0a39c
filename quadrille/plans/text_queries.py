"""Queries on names, polylines and payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrille.functions import text, timeutil
from quadrille.operators import spatial
from quadrille.plans.context_queries import STATIONS, stations
from quadrille.plans.registry import query, table

# written apart from the code: words, then ordinals, then names, then what names no place
_SHORT = "CASE {0} WHEN 'ave' THEN 'av' WHEN 'avenue' THEN 'av' WHEN 'street' THEN 'st' WHEN 'square' THEN 'sq' WHEN 'west' THEN 'w' WHEN 'east' THEN 'e' WHEN 'north' THEN 'n' WHEN 'south' THEN 's' WHEN 'first' THEN '1' WHEN 'second' THEN '2' WHEN 'third' THEN '3' WHEN 'fourth' THEN '4' WHEN 'fifth' THEN '5' WHEN 'sixth' THEN '6' WHEN 'seventh' THEN '7' WHEN 'eighth' THEN '8' WHEN 'ninth' THEN '9' WHEN 'tenth' THEN '10' ELSE {0} END"
_TOKENS = "list_distinct(list_filter(list_transform(list_transform(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda w: CASE WHEN regexp_matches(w, '[0-9](st|nd|rd|th)$') THEN w[:-3] ELSE w END), lambda w: " + _SHORT.format("w").replace("{", "{{").replace("}", "}}") + "), lambda w: w NOT IN ('and', 'the', 'at', 'near', 'of', 'ny', 'nyc', 'new', 'york', 'usa', 'i', 'am', 'im')))"
PLACES = "places AS (SELECT p_name || ' ' || p_type || ['', ' the 21st Street', ' Fifth Avenue', ' near W 3rd Ave, New York', ' 2nd'][1 + p_partkey % 5] AS name, p_partkey % 2 = 0 AS is_station, 40.55::DOUBLE + (p_partkey % 450)::DOUBLE / 1000 AS lat, -74.15::DOUBLE + ((p_partkey * 7) % 450)::DOUBLE / 1000 AS lng FROM part)"


def places(spark, d):
    p, k = table(spark, d, "part"), F.col("p_partkey")
    return p.select(F.concat(F.col("p_name"), F.lit(" "), F.col("p_type"), F.get(F.array(*map(F.lit, ("", " the 21st Street", " Fifth Avenue", " near W 3rd Ave, New York", " 2nd"))), (k % 5).cast("int"))).alias("name"), (k % 2 == 0).alias("is_station"), (40.55 + k % 450 / 1000).alias("lat"), (-74.15 + k * 7 % 450 / 1000).alias("lng"))


@query(f"WITH {PLACES} SELECT name, len({_TOKENS.format('name')}) AS n_tokens, list_aggregate(list_sort({_TOKENS.format('name')}), 'string_agg', ' ') AS tokens FROM places".replace("len(", "CAST(len(").replace(") AS n_tokens", ") AS BIGINT) AS n_tokens"))
def place_tokens(spark, d):
    t = text.tokens(F.col("name"))
    return places(spark, d).select("name", F.size(t).cast("long").alias("n_tokens"), F.concat_ws(" ", F.array_sort(t)).alias("tokens"))


_ASK = "Red Widget 5 Av"


@query(f"""WITH {PLACES}, t AS (SELECT *, {_TOKENS.format('name')} AS own, {_TOKENS.format("'" + _ASK + "'")} AS q FROM places), o AS (SELECT *, len(list_intersect(q, own)) AS shared FROM t),
s AS (SELECT name, lat, lng, shared / (len(q) + len(own) - shared) + CASE WHEN contains(lower(name), '{_ASK.lower()}') THEN 0.35::DOUBLE ELSE 0 END
+ CASE WHEN shared = len(q) AND shared >= 2 THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN is_station THEN 0.02::DOUBLE ELSE 0 END AS score FROM o WHERE shared > 0),
k AS (SELECT *, row_number() OVER (PARTITION BY round(lat, 4), round(lng, 4) ORDER BY score DESC, name) AS n FROM s)
SELECT name, round(lat, 6) AS lat, round(lng, 6) AS lng, round(score, 6) AS score, score >= 0.5 AS is_confident FROM k WHERE n = 1 ORDER BY s.score DESC, name LIMIT 5""".replace("ORDER BY s.score", "ORDER BY k.score"))
def gazetteer_search(spark, d):
    """A top-5 search: the limit is the feature."""
    return text.search_places(places(spark, d), _ASK).select("name", *(F.round(c, 6).alias(c) for c in ("lat", "lng", "score")), "is_confident")


# Six kinds of location texts, with the answer to each said by hand where the text is fixed
_LOCS = [("MAIN  STREET between {t} AVENUE and 5 STREET", "MAIN STREET & {t} AVENUE"), ("Park {t}: Lawn-02 ", "Park {t}"), ("  Pier   {u}: Nike Field ", "Pier {u}: Nike Field"), ("{t} ROAD Dead  End", "{t} ROAD"), ("{t} Between {u} PLACE", "{t} & {u} PLACE"), (" , {t} - BAY between A and B and C: Soccer-11", "{t} - BAY & A"), ("{t} dead-end ,", "{t} dead-end")]


def _concat(pattern: str) -> str:
    return "'" + pattern.replace("{t}", "' || event_type || '").replace("{u}", "' || CAST(user_id AS VARCHAR) || '") + "'"


@query(f"SELECT event_id, CASE event_id % {len(_LOCS)} {' '.join(f'WHEN {i} THEN {_concat(want)}' for i, (_, want) in enumerate(_LOCS))} END AS location FROM events")
def location_normalise(spark, d):
    made = F.element_at(F.array(*(F.replace(F.replace(F.lit(x), F.lit("{t}"), F.col("event_type")), F.lit("{u}"), F.col("user_id").cast("string")) for x, _ in _LOCS)), (F.col("event_id") % len(_LOCS) + 1).cast("int"))
    return table(spark, d, "events").select("event_id", text.event_location(made).alias("location"))


@query("""WITH l AS (SELECT event_id, list_filter(list_transform(string_split('40.' || CAST(event_id % 90 + 10 AS VARCHAR) || ',-73.9 bad 40.8,-73.' || CAST(user_id AS VARCHAR) || ' 40.9,x 41,-74', ' '), lambda p: {'lat': TRY_CAST(string_split(p, ',')[1] AS DOUBLE), 'lng': TRY_CAST(string_split(p, ',')[2] AS DOUBLE)}), lambda p: p.lat IS NOT NULL AND p.lng IS NOT NULL) AS v FROM events)
SELECT event_id, CAST(len(v) AS BIGINT) AS n_vertices, v[1].lat AS start_lat, v[1].lng AS start_lng, v[len(v) // 2 + 1].lat AS mid_lat, v[len(v) // 2 + 1].lng AS mid_lng, v[len(v)].lat AS end_lat, v[len(v)].lng AS end_lng FROM l""")
def polyline_parse(spark, d):
    line = F.concat(F.lit("40."), (F.col("event_id") % 90 + 10).cast("string"), F.lit(",-73.9  bad 40.8,-73."), F.col("user_id").cast("string"), F.lit(" 40.9,x 41,-74 "))
    s = table(spark, d, "events").select("event_id", text.polyline_summary(line).alias("s"))
    return s.select("event_id", "s.n_vertices", *(F.col(f"s.{p}.{c}").alias(f"{p}_{c}") for p in ("start", "mid", "end") for c in ("lat", "lng")))


@query(f"""WITH s AS ({STATIONS}), l AS (SELECT id % 25 AS link_id, lat, lng FROM s) SELECT DISTINCT link_id, CAST(CAST(floor(lat / 0.05) AS BIGINT) AS VARCHAR) || '_' || CAST(CAST(floor(lng / 0.05) AS BIGINT) AS VARCHAR) AS region_id FROM l""")
def link_cells(spark, d):
    """Every cell in which a link's polyline has a vertex."""
    pair = F.concat(F.col("lat").cast("string"), F.lit(","), F.col("lng").cast("string"))
    lines = stations(spark, d).groupBy((F.col("id") % 25).alias("link_id")).agg(F.concat_ws(" ", F.array_sort(F.collect_list(pair))).alias("line"))
    v = lines.select("link_id", F.inline(text.polyline_points(F.col("line"))))
    return v.select("link_id", spatial.SquareGrid(0.05).index(F.col("lat"), F.col("lng")).alias("region_id")).distinct()


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(json_extract(props, '$.none') AS BIGINT) AS missing FROM events")
def json_parse(spark, d):
    p = F.from_json("props", "k long, none long")
    return table(spark, d, "events").select("event_id", p["k"].alias("k"), p["none"].alias("missing"))


@query("SELECT TIMESTAMP '2024-01-01 00:00:00' + h * INTERVAL 1 HOUR AS time, CASE WHEN h % 5 <> 3 THEN h * 1.5::DOUBLE END AS temperature_2m, h::DOUBLE AS rain FROM (SELECT unnest(range(24)) AS h) x")
def payload_rows(spark, d):
    import json

    body = {"hourly": {"time": [f"2024-01-01T{h:02d}:00" for h in range(24)], "temperature_2m": [None if h % 5 == 3 else h * 1.5 for h in range(24)], "rain": [float(h) for h in range(24)]}}
    return text.hourly_payload(spark.createDataFrame([(json.dumps(body),)], "payload string"), "payload", ["temperature_2m", "rain"])


@query("""WITH v(raw, expected) AS (VALUES ('2024-01-05 10:11:12', TIMESTAMP '2024-01-05 10:11:12'), ('2024-01-05 10:11:12.345', TIMESTAMP '2024-01-05 10:11:12.345'), ('1/5/2024 9:05', TIMESTAMP '2024-01-05 09:05:00'), ('1/5/2024 9:05:06', TIMESTAMP '2024-01-05 09:05:06'), ('soon', NULL))
SELECT raw, expected AS parsed FROM v UNION ALL SELECT strftime(ts, '%Y-%m-%d %H:%M:%S'), date_trunc('second', ts) FROM events""")
def timestamp_formats(spark, d):
    fixed = spark.createDataFrame([("2024-01-05 10:11:12",), ("2024-01-05 10:11:12.345",), ("1/5/2024 9:05",), ("1/5/2024 9:05:06",), ("soon",)], "raw string")
    rows = fixed.union(table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")))
    return rows.withColumn("parsed", timeutil.parse_timestamp("raw"))


@query("SELECT strftime(ts, '%m/%d/%Y %I:%M:%S %p') AS raw, date_trunc('second', ts) AS parsed FROM events")
def twelve_hour_clock(spark, d):
    rows = table(spark, d, "events").select(F.date_format("ts", timeutil.TWELVE_HOUR).alias("raw"))
    return rows.withColumn("parsed", timeutil.parse_timestamp("raw", (timeutil.TWELVE_HOUR,)))


@query(f"""WITH s AS ({STATIONS}), c AS (SELECT floor(lat / 0.05) AS r, floor(lng / 0.05) AS q, count(*) AS n FROM s GROUP BY 1, 2), e AS (SELECT *, CAST(round(q * 0.05, 6) AS VARCHAR) AS w, CAST(round(r * 0.05, 6) AS VARCHAR) AS s, CAST(round((q + 1) * 0.05, 6) AS VARCHAR) AS e, CAST(round((r + 1) * 0.05, 6) AS VARCHAR) AS n2, CAST(CAST(r AS BIGINT) AS VARCHAR) || '_' || CAST(CAST(q AS BIGINT) AS VARCHAR) AS id FROM c)
SELECT id AS region_id, '{{"type":"Feature","geometry":{{"type":"Polygon","coordinates":[[[' || w || ',' || s || '],[' || e || ',' || s || '],[' || e || ',' || n2 || '],[' || w || ',' || n2 || '],[' || w || ',' || s || ']]]}},"properties":{{"region_id":"' || id || '","stations":' || CAST(n AS VARCHAR) || '}}}}' AS feature FROM e""")
def region_polygons(spark, d):
    """GeoJSON features of the cells that have stations."""
    g = spatial.SquareGrid(0.05)
    cells = stations(spark, d).groupBy(g.index(F.col("lat"), F.col("lng")).alias("region_id")).agg(F.count("*").alias("stations"))
    ring = F.transform(g.boundary(F.col("region_id")), lambda p: F.transform(p, lambda x: F.round(x, 6)))
    return cells.select("region_id", text.polygon_geojson(ring, {"region_id": F.col("region_id"), "stations": F.col("stations")}).alias("feature"))


_OPENINGS = ("How many bikes are near ", "what about ", "And why ", "See [the map](https://x.y/z) ![i](http://z) ", "will there be any")
_CLOSINGS = (" at 5pm?", " on 2024-06-05 07:15", " around 12:20 AM.", "", " on 2024-07-01T18:45!", " at 13:99 pm")
_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_CLOCK_SQL = r"(?i)\b(\d{1,2})\s*(?::(\d{2}))?\s*(am|pm)\b"


def messages(spark, d):
    """What people ask, made from the conversations: an opening, their text, and a time."""
    c = table(spark, d, "conversations")
    pick = lambda xs, k: F.get(F.array(*map(F.lit, xs)), k.cast("int"))
    return c.select("conv_id", "turn", F.concat(pick(_OPENINGS, F.col("turn") % len(_OPENINGS)), F.coalesce("text", F.lit("")), pick(_CLOSINGS, (F.col("conv_id") + F.col("turn")) % len(_CLOSINGS))).alias("message"))


# written apart from the code: the clock as minutes of the day, the words as a list
@query(rf"""WITH m AS (SELECT conv_id, turn, {_LIST(_OPENINGS)}[1 + turn % {len(_OPENINGS)}] || coalesce(text, '') || {_LIST(_CLOSINGS)}[1 + (conv_id + turn) % {len(_CLOSINGS)}] AS message FROM conversations),
t AS (SELECT *, regexp_extract(message, '\b(\d{{4}}-\d{{2}}-\d{{2}}(?:[T ]\d{{2}}:\d{{2}})?)\b', 1) AS iso, try_cast(regexp_extract(message, '{_CLOCK_SQL}', 1) AS INT) AS h, coalesce(try_cast(regexp_extract(message, '{_CLOCK_SQL}', 2) AS INT), 0) AS mi, lower(regexp_extract(message, '{_CLOCK_SQL}', 3)) AS half,
list_filter(string_split_regex(regexp_replace(regexp_replace(regexp_replace(message, '\b(\d{{4}}-\d{{2}}-\d{{2}}(?:[T ]\d{{2}}:\d{{2}})?)\b', ' ', 'g'), '{_CLOCK_SQL}', ' ', 'g'), '[?.,!]', ' ', 'g'), '\s+'), lambda w: w <> '') AS words FROM m),
p AS (SELECT *, list_filter(words, lambda w: lower(w) NOT IN ({", ".join(f"'{w}'" for w in text.FILLER)})) AS telling FROM t)
SELECT conv_id, turn, strftime(CASE WHEN iso <> '' THEN CAST(iso AS TIMESTAMP) WHEN h BETWEEN 1 AND 12 AND mi < 60 THEN TIMESTAMP '2024-06-03 00:00:00' + to_minutes(60 * (h % 12 + CASE WHEN half = 'pm' THEN 12 ELSE 0 END) + mi) ELSE TIMESTAMP '2024-06-03 09:30:00' END, '%Y-%m-%d %H:%M') AS asked,
array_to_string(CASE WHEN len(telling) > 0 THEN telling ELSE words END, ' ') AS place, regexp_matches(lower(ltrim(message)), '^(?:{"|".join(text.FOLLOW_UPS)})\b') AS goes_on,
regexp_replace(regexp_replace(regexp_replace(message, '!\[[^\]]*\]\([^)]*\)|\[([^\]]+)\]\((?:https?|data):[^)]*\)', '\1', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS clean FROM p""")
def message_requests(spark, d):
    """Times and places that messages ask for, and the messages as they are shown."""
    m = F.col("message")
    asked = text.request_time(m, F.lit("2024-06-03 09:30:00").cast("timestamp_ntz"))
    return messages(spark, d).select("conv_id", "turn", F.date_format(asked, "yyyy-MM-dd HH:mm").alias("asked"), text.request_place(m).alias("place"), text.goes_on(m).alias("goes_on"), text.without_links(m).alias("clean"))
