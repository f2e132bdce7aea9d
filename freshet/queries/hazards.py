"""Zones, alerts, risk classes and targeting."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.functions import geo, risk
from freshet.functions.clock import stamp
from freshet.operators import alerts, explain, targeting, zones
from freshet.queries.gauges import r
from freshet.queries.registry import AS_OF, CTES, query
from freshet.sources import sinks

SEV_RANK = "CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 END"
RANK_SEV = "CASE {} WHEN 4 THEN 'CRITICAL' WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' WHEN 1 THEN 'LOW' END"

CTES.update(
    {
        "made_zones": """
        SELECT CASE WHEN hazard_type = 'flood' THEN 'FLD_' || station_id || '_202401151200'
                    ELSE 'LND_' || trunc(lat * 100)::INTEGER || '_' || trunc(lon * 100)::INTEGER || '_202401151200' END AS zone_id,
               hazard_type, station_id, lat AS center_lat, lon AS center_lon, probability, risk_level,
               CASE risk_level WHEN 'HIGH' THEN 'CRITICAL' WHEN 'MEDIUM' THEN 'HIGH' WHEN 'LOW' THEN 'MEDIUM' ELSE 'LOW' END AS severity,
               CASE risk_level WHEN 'HIGH' THEN 5.0 WHEN 'MEDIUM' THEN 3.0 WHEN 'LOW' THEN 1.0 ELSE 0.5 END::DOUBLE
                 * CASE WHEN hazard_type = 'landslide' THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END AS radius_km,
               lead AS lead_time_hours,
               TIMESTAMP '2024-01-15 12:00:00' + to_hours(CASE WHEN hazard_type = 'flood' THEN lead + 6 ELSE 24 END) AS valid_until
        FROM (SELECT *, CASE WHEN probability >= 0.6 THEN 'HIGH' WHEN probability >= 0.3 THEN 'MEDIUM'
                    WHEN probability >= 0.1 THEN 'LOW' ELSE 'NEGLIGIBLE' END AS risk_level,
                  CASE WHEN probability >= 0.8 THEN 2 WHEN probability >= 0.6 THEN 6
                       WHEN probability >= 0.3 THEN 18 ELSE 42 END AS lead
              FROM stations)""",
        "user_near": """
        SELECT u.user_id, u.lat, u.lon, u.seq, n.zone_id, n.radius_km, n.severity, n.distance_km,
               n.distance_km <= n.radius_km AS is_inside,
               row_number() OVER (PARTITION BY u.user_id ORDER BY n.distance_km, n.zone_id) AS rn
        FROM users u LEFT JOIN near n ON n.user_id = u.user_id""",
        "user_tier": f"""
        SELECT *, CASE WHEN n_inside > 0 THEN 'P0' WHEN km <= edge + 1 THEN 'P1' WHEN km <= edge + 3 THEN 'P2'
                       WHEN km IS NOT NULL THEN 'P3' ELSE 'NONE' END AS priority
        FROM (SELECT user_id, lat, lon, seq, count(*) FILTER (is_inside) AS n_inside,
                string_agg(zone_id, ',' ORDER BY zone_id) FILTER (is_inside) AS inside,
                string_agg(zone_id, ',' ORDER BY rn) FILTER (rn <= 3) AS near3,
                string_agg(zone_id, ',' ORDER BY rn) FILTER (rn <= 2) AS near2,
                string_agg(zone_id, ',' ORDER BY rn) FILTER (rn <= 1) AS near1,
                max(distance_km) FILTER (rn = 1) AS km, max(radius_km) FILTER (rn = 1) AS edge,
                {RANK_SEV.format(f'max({SEV_RANK}) FILTER (is_inside)')} AS worst
              FROM user_near GROUP BY ALL)""",
        "decisions": """
        SELECT user_id, lat, lon, seq, priority, priority <> 'NONE' AS should_alert,
               CASE priority WHEN 'P0' THEN 'EVACUATE' WHEN 'P1' THEN 'STAY_AWAY' WHEN 'P2' THEN 'DIVERT'
                    WHEN 'P3' THEN 'MONITOR' ELSE 'NO_ACTION' END AS action,
               coalesce(CASE priority WHEN 'P0' THEN inside WHEN 'P1' THEN near3 WHEN 'P2' THEN near2 WHEN 'P3' THEN near1 END, '') AS zones,
               CASE priority
                 WHEN 'P0' THEN 'EMERGENCY: You are inside a ' || worst || ' hazard zone. Evacuate immediately.'
                 WHEN 'P1' THEN 'WARNING: Hazard zone ' || printf('%.1f', km) || 'km away. Stay away from the area.'
                 WHEN 'P2' THEN 'CAUTION: Hazard zone ' || printf('%.1f', km) || 'km away. Consider alternate routes.'
                 WHEN 'P3' THEN 'ADVISORY: Hazard activity in region. Monitor official updates.' ELSE '' END AS message,
               CASE priority WHEN 'P0' THEN 'User location inside hazard zone' WHEN 'P1' THEN 'User within 1km of zone edge'
                 WHEN 'P2' THEN 'User within 3km of zone edge'
                 WHEN 'P3' THEN 'User within buffer zone (' || printf('%.1f', km) || 'km)'
                 ELSE 'User outside all hazard zones and buffers' END AS reason
        FROM user_tier""",
    }
)

# the same decisions for users who report at times of their own
CTES["near_moving"] = CTES["near"].replace("users u JOIN active z", "movers u JOIN zones z").replace(
    "ON sqrt", "ON z.valid_until > u.ts AND sqrt"
)
CTES["moving_near"] = CTES["user_near"].replace("users u", "movers u").replace("near n", "near_moving n")
CTES["moving_tier"] = CTES["user_tier"].replace("user_near", "moving_near")
CTES["moving"] = CTES["decisions"].replace("user_tier", "moving_tier")


def made_zones(t):
    level = risk.classify_risk(F.col("probability"))
    scored = t.stations().withColumns(
        {"risk_level": level, "lead_time_hours": risk.estimate_lead_time(F.col("probability"))}
    )
    flood = zones.flood_zones(scored.where("hazard_type = 'flood'"), AS_OF)
    slide = scored.where("hazard_type = 'landslide'").withColumnRenamed("probability", "susceptibility")
    return flood.unionByName(zones.landslide_zones(slide, AS_OF))


def active(t):
    return zones.active_zones(t.zones(), AS_OF)


def decide(t):
    return targeting.user_priority(t.users(), active(t))


def flat(df):
    return df.withColumn("zones", F.array_join("zones", ","))


@query(
    "f1_classify_risk",
    """SELECT key, round(probability, 9) AS probability, CASE WHEN probability >= 0.6 THEN 'HIGH' WHEN probability >= 0.3 THEN 'MEDIUM'
              WHEN probability >= 0.1 THEN 'LOW' ELSE 'NEGLIGIBLE' END AS risk_level FROM stations""",
)
def classify(t):
    return t.stations().select("key", r("probability", 9), risk.classify_risk(F.col("probability")).alias("risk_level"))


@query(
    "f2_confidence",
    """SELECT event_id, CASE WHEN event_type <> 'error' AND value >= 60 THEN 'HIGH'
              WHEN event_type <> 'error' OR value >= 60 THEN 'MODERATE' ELSE 'LOW' END AS confidence FROM events""",
)
def confidence(t):
    quality = F.when(F.col("event_type") != "error", "good").otherwise("gap")
    return t.read("events").select("event_id", risk.confidence(quality, F.col("value") >= 60).alias("confidence"))


@query(
    "f3_estimate_lead_time",
    """WITH b AS (SELECT key, probability, CASE key % 3 WHEN 0 THEN 'increasing' WHEN 1 THEN 'stable' ELSE 'decreasing' END AS trend,
              CASE WHEN probability >= 0.8 THEN 6 WHEN probability >= 0.6 THEN 12 WHEN probability >= 0.3 THEN 24 ELSE 48 END AS base
              FROM stations)
       SELECT key, trend, CASE trend WHEN 'increasing' THEN greatest(2, base - 6) WHEN 'decreasing' THEN base + 6 ELSE base END AS lead_time_hours
       FROM b""",
)
def lead_time(t):
    k = F.col("key") % 3
    trend = F.when(k == 0, "increasing").when(k == 1, "stable").otherwise("decreasing")
    return t.stations().select("key", trend.alias("trend"), risk.estimate_lead_time(F.col("probability"), trend).alias("lead_time_hours"))


@query("f4_radius_km", "SELECT zone_id, risk_level, hazard_type, radius_km FROM zones")
def radii(t):
    level = F.lower("risk_level")
    return t.zones().select("zone_id", "risk_level", "hazard_type", risk.radius_km(level, F.col("hazard_type")).alias("radius_km"))


@query("f5_zone_severity", "SELECT zone_id, risk_level, severity FROM zones")
def severities(t):
    return t.zones().select("zone_id", "risk_level", risk.zone_severity(F.col("risk_level")).alias("severity"))


ZONE_SQL = """SELECT zone_id, hazard_type, severity, center_lat, center_lon, radius_km,
    TIMESTAMP '2024-01-15 12:00:00' AS valid_from, valid_until,
    round(CASE WHEN hazard_type = 'flood' THEN probability END, 9) AS probability,
    round(CASE WHEN hazard_type = 'landslide' THEN probability END, 9) AS susceptibility,
    CASE WHEN hazard_type = 'flood' THEN lead_time_hours END AS lead_time_hours FROM made_zones"""


@query("j13_predictions_to_zones", ZONE_SQL)
def zones_made(t):
    pred = F.col("source_prediction")
    return made_zones(t).select(
        "zone_id", "hazard_type", "severity", "center_lat", "center_lon", "radius_km", "valid_from", "valid_until",
        F.round(pred["probability"], 9).alias("probability"),
        F.round(pred["susceptibility"], 9).alias("susceptibility"),
        pred["lead_time_hours"].alias("lead_time_hours"),
    )


@query(
    "f6_zone_validity",
    """SELECT zone_id, hazard_type, CASE WHEN hazard_type = 'flood' THEN lead_time_hours END AS lead_time_hours, valid_until FROM made_zones""",
)
def validity(t):
    return made_zones(t).select("zone_id", "hazard_type", F.col("source_prediction.lead_time_hours").alias("lead_time_hours"), "valid_until")


@query("f7_zone_id", "SELECT zone_id, hazard_type, center_lat, center_lon FROM made_zones")
def zone_ids(t):
    return made_zones(t).select("zone_id", "hazard_type", "center_lat", "center_lon")


@query(
    "f8_circle_polygon",
    """SELECT zone_id, i::INTEGER AS vertex, round(center_lat + radius_km / 111.0 * sin(2 * pi() * (i % 32) / 32), 6) AS lat,
              round(center_lon + radius_km / (111.0 * cos(radians(center_lat))) * cos(2 * pi() * (i % 32) / 32), 6) AS lon
       FROM zones, unnest(range(0, 33)) AS t(i)""",
)
def circles(t):
    ring = geo.circle_polygon(F.col("center_lat"), F.col("center_lon"), F.col("radius_km"))
    return t.zones().select("zone_id", F.posexplode(ring).alias("vertex", "p")).select(
        "zone_id", "vertex", F.round("p.lat", 6).alias("lat"), F.round("p.lon", 6).alias("lon")
    )


@query(
    "p10_active_zones",
    "SELECT zone_id, hazard_type, severity, radius_km, valid_until FROM active",
)
def active_rows(t):
    return active(t).select("zone_id", "hazard_type", "severity", "radius_km", "valid_until")


@query(
    "p10_expired_zones",
    "SELECT zone_id, valid_until FROM zones WHERE valid_until <= TIMESTAMP '2024-01-15 12:00:00'",
)
def expired_rows(t):
    return zones.expired_zones(t.zones(), AS_OF).select("zone_id", "valid_until")


@query("p11_zones_by_hazard", "SELECT zone_id, hazard_type, severity FROM active WHERE hazard_type = 'flood'")
def by_hazard(t):
    return zones.zones_by_hazard(active(t), "flood").select("zone_id", "hazard_type", "severity")


@query(
    "p15_param_bounds",
    """
    WITH req AS (SELECT c_custkey AS id, c_acctbal / 100 AS lat, c_acctbal / 50 AS lon, c_acctbal / 10000 AS probability,
                        (c_custkey % 80)::DOUBLE AS lead_time_hours, (c_custkey % 60)::DOUBLE AS buffer_km FROM customer)
    SELECT id, concat_ws(',', CASE WHEN lat NOT BETWEEN -90 AND 90 THEN 'lat' END, CASE WHEN lon NOT BETWEEN -180 AND 180 THEN 'lon' END,
           CASE WHEN probability NOT BETWEEN 0 AND 1 THEN 'probability' END, CASE WHEN lead_time_hours NOT BETWEEN 1 AND 72 THEN 'lead_time_hours' END,
           CASE WHEN buffer_km NOT BETWEEN 0.1 AND 50 THEN 'buffer_km' END) AS violations,
           lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND probability BETWEEN 0 AND 1
             AND lead_time_hours BETWEEN 1 AND 72 AND buffer_km BETWEEN 0.1 AND 50 AS is_valid
    FROM req""",
)
def bounds(t):
    k, b = F.col("c_custkey"), F.col("c_acctbal")
    requests = t.read("customer").select(
        k.alias("id"), (b / 100).alias("lat"), (b / 50).alias("lon"), (b / 10000).alias("probability"),
        (k % 80).cast("double").alias("lead_time_hours"), (k % 60).cast("double").alias("buffer_km"),
    )
    return zones.check_bounds(requests).select("id", F.array_join("violations", ",").alias("violations"), "is_valid")


@query(
    "j7_points_in_zones",
    "SELECT user_id, zone_id, round(distance_km, 6) AS distance_km FROM near WHERE distance_km <= radius_km",
)
def inside(t):
    return zones.points_in_zones(t.users(), active(t)).select("user_id", "zone_id", r("distance_km"))


@query("j7_points_endangered", "SELECT DISTINCT user_id FROM near WHERE distance_km <= radius_km")
def endangered(t):
    return zones.points_in_zones(t.users(), active(t), how="left_semi").select("user_id")


@query(
    "j7_points_clear",
    "SELECT user_id FROM users WHERE user_id NOT IN (SELECT user_id FROM near WHERE distance_km <= radius_km)",
)
def clear(t):
    return zones.points_in_zones(t.users(), active(t), how="left_anti").select("user_id")


@query(
    "j8_zones_near_points",
    """SELECT user_id, zone_id, round(distance_km, 6) AS distance_km,
              row_number() OVER (PARTITION BY user_id ORDER BY distance_km, zone_id) AS nearness FROM near""",
)
def nearby(t):
    from pyspark.sql import Window as W

    order = W.partitionBy("user_id").orderBy("distance_km", "zone_id")
    pairs = zones.near_zones(t.users(), active(t), zones.NEAR_KM)
    return pairs.withColumn("nearness", F.row_number().over(order).cast("bigint")).select(
        "user_id", "zone_id", r("distance_km"), "nearness"
    )


@query(
    "f17_planar_km",
    "SELECT user_id, zone_id, round(distance_km, 6) AS distance_km FROM near",
)
def planar(t):
    return zones.near_zones(t.users(), active(t), zones.NEAR_KM).select("user_id", "zone_id", r("distance_km"))


@query(
    "f16_haversine_km",
    """SELECT user_id, round(2 * 6371.0 * atan2(sqrt(a), sqrt(1 - a)), 6) AS km
       FROM (SELECT user_id, sin(radians(26.1445 - lat) / 2) ** 2 + cos(radians(lat)) * cos(radians(26.1445::DOUBLE))
                * sin(radians(91.7362 - lon) / 2) ** 2 AS a FROM users)""",
)
def haversine(t):
    km = geo.haversine_km(F.col("lat"), F.col("lon"), F.lit(26.1445), F.lit(91.7362))
    return t.users().select("user_id", F.round(km, 6).alias("km"))


@query(
    "a21_location_status",
    f"""
    WITH g AS (SELECT user_id, count(*) FILTER (is_inside) AS n_in, count(zone_id) AS n_all,
             coalesce(string_agg(zone_id, ',' ORDER BY zone_id) FILTER (is_inside), '') AS zones_inside,
             {RANK_SEV.format(f'max({SEV_RANK}) FILTER (is_inside)')} AS worst, max(severity) FILTER (rn = 1) AS nearest
           FROM user_near GROUP BY 1),
    o AS (SELECT user_id, string_agg(zone_id || ':' || printf('%.2f', distance_km), ',' ORDER BY rn) AS zones_nearby
          FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rn) AS k FROM user_near
                WHERE zone_id IS NOT NULL AND NOT is_inside) WHERE k <= 5 GROUP BY 1)
    SELECT user_id, CASE WHEN n_in > 0 THEN 'IN_DANGER_ZONE' WHEN n_all > 0 THEN 'NEAR_DANGER_ZONE' ELSE 'CLEAR' END AS status,
           CASE WHEN n_in > 0 THEN worst WHEN n_all > 0 THEN nearest ELSE 'NONE' END AS max_severity,
           zones_inside, coalesce(zones_nearby, '') AS zones_nearby
    FROM g LEFT JOIN o USING (user_id)""",
)
def status(t):
    near = F.transform("zones_nearby", lambda s: F.concat(s["zone_id"], F.lit(":"), F.format_string("%.2f", s["distance_km"])))
    return zones.location_status(t.users(), active(t)).select(
        "user_id", "status", "max_severity", F.array_join("zones_inside", ",").alias("zones_inside"),
        F.array_join(near, ",").alias("zones_nearby"),
    )


@query(
    "u6_nearby_minus_inside",
    "SELECT user_id, zone_id FROM near WHERE distance_km > radius_km",
)
def nearby_only(t):
    near = zones.near_zones(t.users(), active(t), zones.NEAR_KM)
    return near.where(~F.col("is_inside")).select("user_id", "zone_id")


@query(
    "a22_zone_summary",
    """SELECT count(*) FILTER (hazard_type = 'flood') AS flood_zones, count(*) FILTER (hazard_type = 'landslide') AS landslide_zones,
              CASE WHEN count(*) > 0 THEN 'HIGH' ELSE 'LOW' END AS overall FROM active""",
)
def summary(t):
    return zones.zone_summary(active(t))


@query(
    "f21_blocked_segments",
    """SELECT zone_id, hazard_type, center_lat AS lat, center_lon AS lon, radius_km, severity,
              'Blocked due to ' || hazard_type || ' hazard' AS description FROM active""",
)
def blocked(t):
    return zones.blocked_segments(t.zones(), AS_OF).select(
        "zone_id", "hazard_type", "center.lat", "center.lon", "radius_km", "severity", "description"
    )


LEVEL = "CASE WHEN {0} >= 0.6 THEN 4 WHEN {0} >= 0.3 THEN 3 WHEN {0} >= 0.1 THEN 2 ELSE 1 END"


@query(
    "j12_combined_risk",
    f"""
    WITH d AS (SELECT row_id, string_agg(feature || CASE WHEN contribution >= 0 THEN '+' ELSE '-' END || printf('%.3f', abs(contribution)), ' ' ORDER BY rank) AS drivers
               FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY abs(contribution) DESC, feature) AS rank FROM contributions)
               WHERE rank <= 3 GROUP BY 1),
    loc AS (SELECT user_id, seq, 'ST' || (seq // 12) AS station_id, (seq * 7919 % 1000) / 1000.0::DOUBLE AS p FROM users),
    l AS (SELECT loc.*, {LEVEL.format("p")} AS lr, drivers AS landslide_drivers FROM loc LEFT JOIN d ON row_id = seq),
    f AS (SELECT station_id, probability, {LEVEL.format("probability")} AS fr, drivers AS flood_drivers,
            CASE WHEN probability >= 0.8 THEN 2 WHEN probability >= 0.6 THEN 6 WHEN probability >= 0.3 THEN 18 ELSE 42 END AS lead_time_hours
          FROM stations LEFT JOIN d ON row_id = key)
    SELECT user_id, station_id, round(p, 6) AS susceptibility, ['NEGLIGIBLE','LOW','MEDIUM','HIGH'][lr] AS risk_level, landslide_drivers,
           round(probability, 6) AS flood_probability, ['NEGLIGIBLE','LOW','MEDIUM','HIGH'][fr] AS flood_risk, lead_time_hours, flood_drivers,
           ['NEGLIGIBLE','LOW','MEDIUM','HIGH'][greatest(lr, coalesce(fr, 0))] AS overall_risk
    FROM l LEFT JOIN f USING (station_id)""",
)
def combined(t):
    drivers = explain.driver_strings(t.contributions())
    k = F.col("seq")
    p = (k * 7919 % 1000) / 1000.0
    slides = t.users().select(
        "user_id", k.cast("bigint").alias("row_id"), F.concat(F.lit("ST"), F.floor(k / 12)).alias("station_id"),
        p.alias("susceptibility"), risk.classify_risk(p).alias("risk_level"),
    ).join(drivers, "row_id", "left")
    flood = t.stations().select(
        F.col("key").cast("bigint").alias("row_id"), "station_id", "probability",
        risk.classify_risk(F.col("probability")).alias("risk_level"), risk.estimate_lead_time(F.col("probability")).alias("lead_time_hours"),
    ).join(drivers, "row_id", "left")
    made = zones.combined_risk(slides, flood)

    def joined(c):
        return F.when(F.col(c).isNotNull(), F.array_join(F.transform(c, lambda d: F.concat(d["feature"], d["impact"])), " ")).alias(c)

    return made.select(
        "user_id", "station_id", r("susceptibility"), "risk_level", joined("landslide_drivers"), r("flood_probability"), "flood_risk",
        "lead_time_hours", joined("flood_drivers"), "overall_risk",
    )


@query(
    "f9_alert_type",
    """SELECT zone_id, CASE WHEN hazard_type = 'flood' AND severity IN ('CRITICAL', 'HIGH') THEN 'FLOOD_WARNING' WHEN hazard_type = 'flood' THEN 'FLOOD_WATCH'
              WHEN severity IN ('CRITICAL', 'HIGH') THEN 'LANDSLIDE_ALERT' ELSE 'LANDSLIDE_WATCH' END AS alert_type FROM zones""",
)
def types(t):
    return t.zones().select("zone_id", alerts.alert_type(F.col("hazard_type"), F.col("severity")).alias("alert_type"))


@query(
    "f10_alert_severity",
    """SELECT zone_id, severity, CASE severity WHEN 'CRITICAL' THEN 'EXTREME' WHEN 'HIGH' THEN 'SEVERE' WHEN 'LOW' THEN 'MINOR' ELSE 'MODERATE' END AS alert_severity
       FROM zones""",
)
def alert_levels(t):
    return t.zones().select("zone_id", "severity", alerts.alert_severity(F.col("severity")).alias("alert_severity"))


@query(
    "f11_recommended_action",
    """SELECT zone_id, CASE severity WHEN 'CRITICAL' THEN 'EVACUATE IMMEDIATELY to higher ground. Follow official instructions.'
              WHEN 'HIGH' THEN 'PREPARE TO EVACUATE. Move valuables to upper floors. Avoid low-lying areas.'
              WHEN 'LOW' THEN 'BE AWARE. Stay informed of weather conditions.'
              ELSE 'STAY ALERT. Monitor official channels. Avoid unnecessary travel in affected areas.' END AS recommended_action FROM zones""",
)
def actions(t):
    level = alerts.alert_severity(F.col("severity"))
    return t.zones().select("zone_id", alerts.recommended_action(level).alias("recommended_action"))


ALERT_SQL = """
    SELECT 'ALT_20240115_' || upper(substr(sha256(zone_id || '2024-01-15 12:00:00'), 1, 8)) AS alert_id, zone_id,
      CASE WHEN hazard_type = 'flood' AND severity IN ('CRITICAL', 'HIGH') THEN 'FLOOD_WARNING' WHEN hazard_type = 'flood' THEN 'FLOOD_WATCH'
           WHEN severity IN ('CRITICAL', 'HIGH') THEN 'LANDSLIDE_ALERT' ELSE 'LANDSLIDE_WATCH' END AS alert_type,
      CASE severity WHEN 'CRITICAL' THEN 'EXTREME' WHEN 'HIGH' THEN 'SEVERE' WHEN 'LOW' THEN 'MINOR' ELSE 'MODERATE' END AS severity,
      center_lat AS lat, center_lon AS lon, radius_km,
      CASE WHEN hazard_type = 'flood' THEN alert_type || ': Flood Risk in ' || station_id
           ELSE alert_type || printf(': Landslide Risk at (%.2f, %.2f)', center_lat, center_lon) END AS headline,
      CASE WHEN hazard_type = 'flood' THEN printf('Flood risk detected near %s. Probability: %.0f%%. Expected within %d hours. Affected radius: %.1fkm. Avoid low-lying areas and waterways.',
             station_id, probability * 100, lead_time_hours, radius_km)
           ELSE printf('Landslide susceptibility elevated in area. Susceptibility: %.0f%%. Affected radius: %.1fkm. Avoid steep slopes, cuts, and unstable terrain.',
             probability * 100, radius_km) END AS message,
      TIMESTAMP '2024-01-15 12:00:00' AS issued_at, valid_until AS expires_at
    FROM made_zones"""


def made_alerts(t):
    return alerts.alerts_from_zones(made_zones(t), AS_OF)


@query("f15_alerts_from_zones", ALERT_SQL)
def zone_alerts(t):
    return made_alerts(t).select(
        "alert_id", "zone_id", "alert_type", "severity", "center.lat", "center.lon", "radius_km", "headline", "message",
        "issued_at", "expires_at",
    )


@query("f12_alert_text", f"SELECT zone_id, headline, message FROM ({ALERT_SQL})")
def alert_text(t):
    return made_alerts(t).select("zone_id", "headline", "message")


@query("f13_alert_id", f"SELECT zone_id, alert_id FROM ({ALERT_SQL})")
def alert_ids(t):
    return made_alerts(t).select("zone_id", "alert_id")


@query(
    "f14_all_clear",
    """SELECT zone_id, 'CLR_20240115_' || upper(substr(sha256(zone_id || '2024-01-15 12:00:00'), 1, 8)) AS alert_id, 'MINOR' AS severity,
              'ALL CLEAR: Hazard zone ' || zone_id || ' has been cleared' AS headline,
              'The previous hazard warning has been lifted. Normal activities may resume.' AS message,
              TIMESTAMP '2024-01-15 13:00:00' AS expires_at
       FROM zones WHERE valid_until <= TIMESTAMP '2024-01-15 12:00:00'""",
)
def cleared(t):
    return alerts.all_clear(t.zones(), AS_OF).select("zone_id", "alert_id", "severity", "headline", "message", "expires_at")


@query(
    "s11_alert_records",
    f"""SELECT alert_id, lat, lon, strftime(issued_at, '%Y-%m-%dT%H:%M:%S') AS issued_at,
               strftime(expires_at, '%Y-%m-%dT%H:%M:%S') AS expires_at FROM ({ALERT_SQL})""",
)
def alert_records(t):
    return sinks.alert_records(made_alerts(t)).select("alert_id", "center.lat", "center.lon", "issued_at", "expires_at")


@query(
    "s10_zones_geojson",
    """SELECT zone_id, hazard_type, 'Polygon' AS geometry_type, 33 AS vertices,
              round(center_lon + radius_km / (111.0 * cos(radians(center_lat))), 6) AS first_lon, round(center_lat, 6) AS first_lat,
              strftime(valid_until, '%Y-%m-%dT%H:%M:%S') AS valid_until FROM made_zones""",
)
def geojson(t):
    schema = (
        "type string, geometry struct<type: string, coordinates: array<array<array<double>>>>,"
        "properties struct<zone_id: string, hazard_type: string, valid_until: string>"
    )
    parsed = sinks.zone_features(made_zones(t)).select(F.from_json("feature", schema).alias("f"))
    ring = F.col("f.geometry.coordinates")[0]
    return parsed.select(
        "f.properties.zone_id", "f.properties.hazard_type", F.col("f.geometry.type").alias("geometry_type"),
        F.size(ring).alias("vertices"), F.round(ring[0][0], 6).alias("first_lon"), F.round(ring[0][1], 6).alias("first_lat"),
        "f.properties.valid_until",
    )


@query(
    "s10_zone_collections",
    """SELECT hazard_type, count(*) AS features FROM made_zones GROUP BY 1""",
)
def collections(t):
    schema = "type string, features array<struct<type: string>>"
    parsed = sinks.zone_collections(made_zones(t)).select("hazard_type", F.from_json("collection", schema).alias("c"))
    return parsed.groupBy("hazard_type").agg(F.sum(F.size("c.features")).alias("features"))


@query("f18_user_priority", "SELECT user_id, should_alert, priority, action, zones, message, reason FROM decisions")
def priority(t):
    return flat(decide(t)).select("user_id", "should_alert", "priority", "action", "zones", "message", "reason")


@query(
    "a20_priority_counts",
    """SELECT p.priority, count(user_id) AS users FROM (VALUES ('P0'), ('P1'), ('P2'), ('P3'), ('NONE')) AS p(priority)
       LEFT JOIN decisions d ON d.priority = p.priority GROUP BY 1""",
)
def counts(t):
    return targeting.priority_counts(decide(t))


@query(
    "t6_dispatch_queue",
    """SELECT user_id, priority, action, message, zones, CASE priority WHEN 'P0' THEN 1 WHEN 'P1' THEN 2 WHEN 'P2' THEN 3 ELSE 4 END AS dispatch_order
       FROM decisions WHERE priority <> 'NONE'""",
)
def dispatch(t):
    return flat(targeting.dispatch_queue(decide(t), ["seq"])).select(
        "user_id", "priority", "action", "message", "zones", "dispatch_order"
    )


@query(
    "t7_evacuation_waves",
    """
    WITH w AS (SELECT *, CASE WHEN priority = 'P0' AND count(*) FILTER (priority = 'P0') OVER () > 20
                 THEN ((row_number() OVER (PARTITION BY priority ORDER BY seq) - 1) % 3 + 1)::INTEGER END AS wave FROM decisions)
    SELECT user_id, priority, wave, message || CASE WHEN wave IS NULL THEN '' ELSE ' [Evacuation Wave ' || wave || ']' END AS message FROM w""",
)
def waves(t):
    return targeting.evacuation_waves(decide(t), ["seq"], limit=20).select("user_id", "priority", "wave", "message")


@query(
    "t11_alerts_by_priority",
    """SELECT user_id, priority, CASE priority WHEN 'P0' THEN 1 WHEN 'P1' THEN 2 WHEN 'P2' THEN 3 WHEN 'P3' THEN 4 ELSE 5 END AS rank FROM decisions""",
)
def sorted_alerts(t):
    return targeting.alerts_by_priority(decide(t), ["seq"]).select("user_id", "priority", "rank")
