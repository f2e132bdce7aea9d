"""Routes, landed payloads and catalogs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from freshet.operators import routes
from freshet.operators.zones import active_zones
from freshet.queries.gauges import r
from freshet.queries.registry import AS_OF, CTES, query
from freshet.session import checkpoint_root, materialize
from freshet.sources import catalogs, datasets, payloads, sinks

CTES.update(
    {
        "samples": """
        SELECT * FROM (SELECT *, max(pos) OVER (PARTITION BY route_id) AS last_pos FROM vertices) WHERE pos % 10 = 0 OR pos = last_pos""",
        "hits": """
        SELECT DISTINCT v.route_id, z.zone_id, z.center_lat, z.center_lon, z.radius_km FROM samples v JOIN active z
          ON sqrt(((v.lat - center_lat) * 111.0) ** 2 + ((v.lon - center_lon) * 111.0 * cos(radians(center_lat))) ** 2) <= radius_km""",
        "detour_hits": """
        SELECT DISTINCT v.route_id, z.zone_id FROM samples v JOIN active z
          ON sqrt(((v.lat + 0.03 - center_lat) * 111.0) ** 2 + ((v.lon - center_lon) * 111.0 * cos(radians(center_lat))) ** 2) <= radius_km""",
        "requests": """
        SELECT route_id, arg_min(lat, pos) AS o_lat, arg_min(lon, pos) AS o_lon, arg_max(lat, pos) AS d_lat, arg_max(lon, pos) AS d_lon
        FROM vertices GROUP BY 1""",
        "fallback": """
        SELECT *, 2 * 6371.0 * atan2(sqrt(a), sqrt(1 - a)) AS km FROM (
          SELECT *, sin(radians(d_lat - o_lat) / 2) ** 2 + cos(radians(o_lat)) * cos(radians(d_lat)) * sin(radians(d_lon - o_lon) / 2) ** 2 AS a
          FROM requests)""",
        "statuses": """
        SELECT f.route_id, h.zones AS hit, h2.zones AS hit2, o_orderkey IS NOT NULL AS direct, round(o_totalprice / 997, 6) AS direct_km,
               trunc(o_totalprice / 1009)::INTEGER AS direct_eta, round(o_totalprice / 991, 6) AS detour_km, trunc(o_totalprice / 1001)::INTEGER AS detour_eta,
               round(f.km, 6) AS line_km, trunc(f.km / 30 * 60)::INTEGER AS line_eta
        FROM fallback f LEFT JOIN (SELECT route_id, string_agg(zone_id, ', ' ORDER BY zone_id) AS zones FROM hits GROUP BY 1) h ON h.route_id = f.route_id
        LEFT JOIN (SELECT route_id, string_agg(zone_id, ', ' ORDER BY zone_id) AS zones FROM detour_hits GROUP BY 1) h2 ON h2.route_id = f.route_id
        LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') o ON o_orderkey = f.route_id""",
    }
)

STATUS_SQL = """
    SELECT route_id, CASE WHEN direct AND (hit IS NULL OR hit2 IS NULL) THEN 'SAFE' WHEN direct THEN 'BLOCKED' ELSE 'UNKNOWN' END AS route_status,
           CASE WHEN direct AND hit IS NULL THEN direct_km WHEN direct THEN detour_km ELSE line_km END AS distance_km,
           CASE WHEN direct AND hit IS NULL THEN direct_eta WHEN direct THEN detour_eta ELSE line_eta END AS eta_minutes,
           CASE WHEN direct AND hit IS NOT NULL AND hit2 IS NULL THEN hit ELSE '' END AS avoided_hazards,
           CASE WHEN direct AND hit IS NULL THEN '' WHEN direct AND hit2 IS NULL THEN 'Detour applied to avoid: ' || hit
                WHEN direct THEN 'Route unavoidably passes through: ' || hit2 || '; Exercise extreme caution or postpone travel'
                ELSE 'Routing service unavailable. Showing straight-line distance.' END AS warnings FROM statuses"""


def scratch(t) -> str:
    return f"{checkpoint_root(t.spark)}/freshet-{uuid.uuid4().hex}"


def requests(t, vertices=None):
    point = F.struct("lat", "lon")
    return (t.vertices() if vertices is None else vertices).groupBy("route_id").agg(
        F.min_by(point, "pos").alias("origin"), F.max_by(point, "pos").alias("destination")
    )


def active(t):
    return active_zones(t.zones(), AS_OF)


def statuses(t):
    vertices = materialize(t.vertices())
    shifted = vertices.withColumn("lat", F.col("lat") + 0.03)
    done = t.read("orders").where("o_orderstatus <> 'P'")
    price = F.col("o_totalprice")
    direct = done.select(F.col("o_orderkey").alias("route_id"), (price / 997).alias("distance_km"), (price / 1009).cast("int").alias("eta_minutes"))
    detour = done.select(F.col("o_orderkey").alias("route_id"), (price / 991).alias("distance_km"), (price / 1001).cast("int").alias("eta_minutes"))
    return routes.route_status(
        requests(t, vertices), direct, detour, routes.route_zones(vertices, active(t)), routes.route_zones(shifted, active(t))
    )


@query("t5_sample_vertices", "SELECT route_id, pos, round(lat, 6) AS lat, round(lon, 6) AS lon FROM samples")
def sampled(t):
    return routes.sample_vertices(t.vertices()).select("route_id", "pos", r("lat"), r("lon"))


@query("j9_route_zones", "SELECT route_id, string_agg(zone_id, ',' ORDER BY zone_id) AS zones FROM hits GROUP BY 1")
def hit_zones(t):
    return routes.route_zones(t.vertices(), active(t)).select("route_id", F.array_join("zones", ",").alias("zones"))


@query("u5_affected_zones", "SELECT zone_id, count(*) AS routes FROM hits GROUP BY 1")
def affected(t):
    return routes.route_hits(t.vertices(), active(t)).groupBy("zone_id").agg(F.count(F.lit(1)).alias("routes"))


@query(
    "j10_nearest_hazard",
    """
    WITH m AS (SELECT r.route_id, (o_lat + d_lat) / 2 AS mid_lat, (o_lon + d_lon) / 2 AS mid_lon, zone_id, center_lat, center_lon
               FROM requests r JOIN hits h ON h.route_id = r.route_id),
    k AS (SELECT *, sin(radians(center_lat - mid_lat) / 2) ** 2 + cos(radians(mid_lat)) * cos(radians(center_lat)) * sin(radians(center_lon - mid_lon) / 2) ** 2 AS a FROM m)
    SELECT route_id, zone_id, round(mid_lat + (mid_lat - center_lat) * 0.5, 6) AS lat, round(mid_lon + (mid_lon - center_lon) * 0.5, 6) AS lon
    FROM (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY atan2(sqrt(a), sqrt(1 - a)), zone_id) AS rn FROM k) WHERE rn = 1""",
)
def waypoints(t):
    hits = routes.route_hits(t.vertices(), active(t))
    return routes.avoidance_waypoints(requests(t), hits).select("route_id", "zone_id", r("lat"), r("lon"))


@query("f19_eta_fallback", "SELECT route_id, round(km, 6) AS distance_km, trunc(km / 30 * 60)::INTEGER AS eta_minutes, 'UNKNOWN' AS route_status FROM fallback")
def fallback(t):
    return routes.eta_fallback(requests(t)).select("route_id", r("distance_km"), "eta_minutes", "route_status")


@query("f20_route_status", STATUS_SQL)
def status(t):
    return statuses(t).select(
        "route_id", "route_status", r("distance_km"), "eta_minutes", F.array_join("avoided_hazards", ", ").alias("avoided_hazards"),
        F.array_join("warnings", "; ").alias("warnings"),
    )


@query("f20_route_safety", f"SELECT route_id, route_status = 'SAFE' AS is_safe, route_status, warnings FROM ({STATUS_SQL})")
def safety(t):
    return routes.route_safety(statuses(t)).select("route_id", "is_safe", "route_status", F.array_join("warnings", "; ").alias("warnings"))


@query(
    "s11_route_records",
    f"""SELECT s.route_id, route_status, eta_minutes, 0 AS segment_count, 0 AS steps_count, round(o_lat, 6) AS origin_lat, round(d_lat, 6) AS destination_lat
        FROM ({STATUS_SQL}) s JOIN requests r ON r.route_id = s.route_id""",
)
def records(t):
    return sinks.route_records(statuses(t)).select(
        "route_id", "route_status", "eta_minutes", "segment_count", "steps_count",
        F.round("origin.lat", 6).alias("origin_lat"), F.round("destination.lat", 6).alias("destination_lat"),
    )


@query(
    "s7_parse_route_payload",
    """SELECT v.route_id, count(*) AS vertices, round(sum(lat), 4) AS lat_sum, round(any_value(o_totalprice) / 1000, 6) AS distance_km,
              trunc(any_value(o_totalprice) / 60)::INTEGER AS duration_minutes, count(*) AS steps
       FROM vertices v JOIN orders ON o_orderkey = v.route_id GROUP BY 1""",
)
def route_payload(t):
    vertex = F.struct("pos", F.array("lon", "lat").alias("xy"))
    step = F.struct(F.concat(F.lit("turn "), "pos").alias("instruction"), F.col("lat").alias("distance"), F.col("lon").alias("duration"))
    # a route payload is one document per route, as the routing service delivers it
    docs = (
        t.vertices().groupBy("route_id").agg(F.sort_array(F.collect_list(vertex)).alias("_v"), F.collect_list(step).alias("_s"))
        .join(t.read("orders").select(F.col("o_orderkey").alias("route_id"), "o_totalprice"), "route_id")
    )
    properties = F.struct(
        F.struct(F.col("o_totalprice").alias("distance"), F.col("o_totalprice").alias("duration")).alias("summary"),
        F.array(F.struct(F.col("_s").alias("steps"))).alias("segments"),
    )
    geometry = F.struct(F.transform("_v", lambda v: v["xy"]).alias("coordinates"))
    payload = F.to_json(F.struct(F.array(F.struct(geometry.alias("geometry"), properties.alias("properties"))).alias("features")))
    parsed = payloads.parse_route_payload(docs.select("route_id", payload.alias("payload")))
    total = F.aggregate("coordinates", F.lit(0.0), lambda acc, p: acc + p["lat"])
    return parsed.select(
        "route_id", F.size("coordinates").cast("bigint").alias("vertices"), F.round(total, 4).alias("lat_sum"), r("distance_km"),
        "duration_minutes", F.size("steps").cast("bigint").alias("steps"),
    )


@query(
    "s6_parse_hourly_payload",
    """SELECT station_id, "timestamp", round(water_level, 6) AS water_level, round(water_level - 49, 6) AS margin FROM gauge""",
)
def hourly_payload(t):
    row = F.struct("timestamp", "water_level")
    # landed documents cover one station and day each
    docs = t.gauge().groupBy("station_id", F.to_date("timestamp").alias("day")).agg(F.sort_array(F.collect_list(row)).alias("_r"))
    hourly = F.struct(
        F.transform("_r", lambda x: F.date_format(x["timestamp"], "yyyy-MM-dd'T'HH:mm")).alias("time"),
        F.transform("_r", lambda x: x["water_level"]).alias("water_level"),
        F.transform("_r", lambda x: x["water_level"] - 49).alias("margin"),
    )
    landed = docs.select("station_id", F.to_json(F.struct(hourly.alias("hourly"))).alias("payload"))
    rows = payloads.parse_hourly_payload(landed, ["water_level", "margin"], keep=["station_id"])
    return rows.select("station_id", "timestamp", r("water_level"), r("margin"))


FORMATS = ["yyyy-MM-dd", "yyyy/MM/dd", "dd-MM-yyyy", "dd/MM/yyyy", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "MM/dd/yyyy", "MM-dd-yyyy"]
# month-first text is read day-first whenever the day could be a month
PARSED = """CASE WHEN (l_orderkey + l_linenumber) % 8 >= 6 AND day(l_shipdate) <= 12 THEN make_date(year(l_shipdate), day(l_shipdate), month(l_shipdate)) ELSE l_shipdate::DATE END"""
CTES["catalog"] = f"""
    SELECT l_orderkey, l_linenumber, l_partkey, {PARSED}::TIMESTAMP AS "timestamp", 4 + (l_orderkey * 104729 % 36000) / 1000.0::DOUBLE AS lat,
           66 + (l_partkey * 7919 % 36000) / 1000.0::DOUBLE AS lon FROM lineitem"""
CTES["catalog_in"] = "SELECT * FROM catalog WHERE lat BETWEEN 6 AND 37 AND lon BETWEEN 68 AND 98"


def dated(t):
    """lineitem as a raw catalog: dates written in eight formats by turns."""
    styles = [F.date_format("l_shipdate", f) for f in FORMATS]
    text = styles[-1]
    for i, s in enumerate(styles[:-1]):
        text = F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 8 == i, s).otherwise(text)
    return t.read("lineitem").select(
        "l_orderkey", "l_linenumber", text.alias("event_date"),
        (4 + (F.col("l_orderkey") * 104729 % 36000) / 1000.0).alias("latitude"),
        (66 + (F.col("l_partkey") * 7919 % 36000) / 1000.0).alias("longitude"),
        F.concat(F.lit("site "), "l_partkey").alias("location_description"),
    )


def landed_csv(t, df):
    path = scratch(t)
    df.write.csv(path, header=True)
    return path


@query("f27_parse_date", f"SELECT l_orderkey, l_linenumber, \"timestamp\" FROM catalog")
def parsed_dates(t):
    return dated(t).select("l_orderkey", "l_linenumber", catalogs.parse_date(F.col("event_date")).alias("timestamp"))


@query("p1_bbox_filter", "SELECT l_orderkey, l_linenumber, lat, lon FROM catalog_in")
def boxed(t):
    rows = dated(t).select("l_orderkey", "l_linenumber", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    return catalogs.bbox_filter(rows)


@query(
    "s1_read_landslide_catalog",
    """SELECT "timestamp", lat, lon, 'landslide' AS event_type, 'NASA_GLC' AS source, 'site ' || l_partkey AS location_name,
              NULL::DOUBLE AS fatalities FROM catalog_in""",
)
def catalog(t):
    return catalogs.read_landslide_catalog(t.spark, landed_csv(t, dated(t)))


@query(
    "s2_read_custom_catalog",
    """SELECT "timestamp", lat, lon, 'Line ' || l_linenumber AS event_type, true AS source_is_file FROM catalog_in""",
)
def custom(t):
    raw = dated(t).select(
        F.col("event_date").alias("When"), F.col("latitude").alias("Y"), F.col("longitude").alias("X"),
        F.concat(F.lit("Line "), "l_linenumber").alias("Kind"),
    )
    names = {"When": "timestamp", "Y": "lat", "X": "lon", "Kind": "event_type"}
    path = landed_csv(t, raw)
    read = catalogs.read_custom_catalog(t.spark, path, names)
    # Spark names the files it lands, so the whole source is held against the folder's own listing
    listed = t.spark.read.format("binaryFile").load(path).select(
        F.concat(F.lit("CUSTOM_"), F.regexp_extract("path", r"([^/]+)\.[^./]*$", 1)).alias("source"), F.lit(True).alias("source_is_file")
    )
    return read.join(listed, "source", "left").select("timestamp", "lat", "lon", "event_type", "source_is_file")


@query("s3_read_inventory", "SELECT l_orderkey || '-' || l_linenumber AS landslide_id, round(lat, 6) AS lat, round(lon, 6) AS lon, date FROM slides")
def inventory(t):
    raw = t.slides().select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("landslide_id"), "lat", "lon", "date")
    return catalogs.read_inventory(t.spark, landed_csv(t, raw)).select("landslide_id", r("lat"), r("lon"), "date")


@query("p4_normalize_catalog", 'SELECT DISTINCT "timestamp", lat, lon FROM catalog_in')
def normalized(t):
    rows = catalogs.standardize(dated(t), catalogs.CATALOG_NAMES, F.lit(catalogs.CATALOG_SOURCE))
    return catalogs.normalize_catalog(rows).select("timestamp", "lat", "lon")


@query("s4_dataset_roundtrip", 'SELECT station_id, "timestamp", round(water_level, 6) AS water_level FROM gauge')
def roundtrip(t):
    path, df = scratch(t), t.gauge()
    datasets.write_dataset(df, path, "csv")
    return datasets.read_dataset(t.spark, path, df.schema, "csv").select("station_id", "timestamp", r("water_level"))


@query(
    "s5_weather_store",
    """SELECT catchment_id, "timestamp", round(rainfall_mm, 6) AS rainfall_mm,
              substr(sha256('historical_' || catchment_id || '_' || strftime("timestamp", '%Y-%m-%d')), 1, 16) AS key
       FROM rain_hourly WHERE "timestamp"::DATE >= DATE '2024-01-11'
       UNION ALL SELECT catchment_id, "timestamp", round(rainfall_mm, 6), 'late' FROM rain_hourly WHERE "timestamp"::DATE >= DATE '2024-01-20'""",
)
def store(t):
    from freshet.queries.gauges import rain_hourly

    path = scratch(t)
    datasets.write_weather(rain_hourly(t), path, "historical")
    datasets.prune_weather(t.spark, path, "2024-01-31", days=20)
    # what pruning left, and of that what a later start reads
    left = datasets.read_weather(t.spark, path, "historical", start="2024-01-05")
    late = datasets.read_weather(t.spark, path, "historical", start="2024-01-20").withColumn("key", F.lit("late"))
    return left.unionByName(late).select("catchment_id", "timestamp", r("rainfall_mm"), "key")


@query(
    "s5_weather_merge",
    """WITH n AS (SELECT *, substr(catchment_id, 3)::BIGINT AS k FROM rain_hourly)
    SELECT catchment_id, "timestamp", round(CASE WHEN k % 3 = 0 THEN 2 * rainfall_mm ELSE rainfall_mm END, 6) AS rainfall_mm, 'historical' AS kind FROM n
    UNION ALL SELECT catchment_id, "timestamp", round(rainfall_mm, 6), 'forecast' FROM n WHERE k % 2 = 0""",
)
def merged_store(t):
    """Catchments arrive in turns, some dates of some come again, and one kind leaves the other alone."""
    from freshet.queries.gauges import rain_hourly

    path, rain = scratch(t), rain_hourly(t)
    k = F.substring("catchment_id", 3, 20).cast("bigint")
    for part in (rain.where(k % 2 == 0), rain.where(k % 2 == 1)):
        datasets.write_weather(part, path, "historical")
    datasets.write_weather(rain.where(k % 2 == 0), path, "forecast")
    again = rain.where(k % 3 == 0).withColumn("rainfall_mm", 2 * F.col("rainfall_mm"))
    for _ in range(2):  # a repeat replaces only its own rows
        datasets.write_weather(again, path, "historical")
    return datasets.read_weather(t.spark, path).select("catchment_id", "timestamp", r("rainfall_mm"), "kind")


@query(
    "s9_station_dim",
    """SELECT station_id, 49.0::DOUBLE AS warning_level, 50.0::DOUBLE AS danger_level, lat AS latitude, lon AS longitude FROM stations""",
)
def station_dim(t):
    docs = t.stations().select(
        "station_id", F.lit(49.0).alias("warning_level"), F.lit(50.0).alias("danger_level"),
        F.col("lat").alias("latitude"), F.col("lon").alias("longitude"),
    )
    lines, single = scratch(t), scratch(t)
    # some land as one document per file, the bulk as lines
    few = F.col("station_id").isin("ST1", "ST2", "ST3")
    docs.where(few).write.option("maxRecordsPerFile", 1).json(single)
    docs.where(~few).write.json(lines)
    both = payloads.read_station_dim(t.spark, single).unionByName(payloads.read_station_dim(t.spark, lines, lines=True))
    return both.select("station_id", "warning_level", "danger_level", "latitude", "longitude")


@query("u1_union_of_stations", 'SELECT station_id, count(*) AS rows FROM (SELECT station_id FROM gauge UNION ALL SELECT catchment_id FROM rain_hourly) GROUP BY 1')
def union(t):
    from freshet.queries.features import rain_series

    both = t.gauge().select("station_id").unionByName(rain_series(t).select("station_id"))
    return both.groupBy("station_id").agg(F.count(F.lit(1)).alias("rows"))
