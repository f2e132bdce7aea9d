"""Risk classes, zone sizes and severities as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Class limits, lead times, radii and severities.
RISK_LIMITS = {"HIGH": 0.6, "MEDIUM": 0.3, "LOW": 0.1}
LOWEST_RISK = "NEGLIGIBLE"
LEAD_HOURS = {0.8: 6, 0.6: 12, 0.3: 24}
LONGEST_LEAD_HOURS = 48
TREND_HOURS = 6
SHORTEST_LEAD_HOURS = 2
RADIUS_KM = {"HIGH": 5.0, "MEDIUM": 3.0, "LOW": 1.0, "NEGLIGIBLE": 0.5}
OTHER_RADIUS_KM = 1.0
LANDSLIDE_RADIUS_SHARE = 0.6
ZONE_SEVERITY = {"HIGH": "CRITICAL", "MEDIUM": "HIGH", "LOW": "MEDIUM", "NEGLIGIBLE": "LOW"}
OTHER_SEVERITY = "MEDIUM"
RISK_RANK = {"NEGLIGIBLE": 1, "LOW": 2, "MEDIUM": 3, "HIGH": 4}
SEVERITY_RANK = {"LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}


def choose(value: Column, mapping: dict, otherwise=None) -> Column:
    """CASE value WHEN … over a fixed mapping."""
    result = None
    for key, out in mapping.items():
        result = F.when(value == key, F.lit(out)) if result is None else result.when(value == key, F.lit(out))
    return result.otherwise(F.lit(otherwise))


def at_least(value: Column, limits: dict, otherwise) -> Column:
    """First result whose lower limit the value reaches; `limits` maps limit -> result, high to low."""
    result = None
    for limit, out in limits.items():
        result = F.when(value >= limit, F.lit(out)) if result is None else result.when(value >= limit, F.lit(out))
    return result.otherwise(F.lit(otherwise))


def classify_risk(probability: Column) -> Column:
    limits = {limit: name for name, limit in RISK_LIMITS.items()}
    return F.when(probability.isNotNull(), at_least(probability, limits, LOWEST_RISK))


def confidence(quality: Column, cached: Column) -> Column:
    good = F.coalesce(quality == "good", F.lit(False))
    cached = F.coalesce(cached, F.lit(False))
    return F.when(good & cached, "HIGH").when(good | cached, "MODERATE").otherwise("LOW")


def estimate_lead_time(probability: Column, trend: Column | None = None) -> Column:
    trend = F.lit("increasing") if trend is None else trend
    base = at_least(probability, LEAD_HOURS, LONGEST_LEAD_HOURS)
    return (
        F.when(trend == "increasing", F.greatest(F.lit(SHORTEST_LEAD_HOURS), base - TREND_HOURS))
        .when(trend == "decreasing", base + TREND_HOURS)
        .otherwise(base)
    )


def radius_km(risk_level: Column, hazard: Column | None = None) -> Column:
    base = choose(F.upper(risk_level), RADIUS_KM, OTHER_RADIUS_KM)
    if hazard is None:
        return base
    return base * F.when(hazard == "landslide", F.lit(LANDSLIDE_RADIUS_SHARE)).otherwise(F.lit(1.0))


def zone_severity(risk_level: Column) -> Column:
    return choose(F.upper(risk_level), ZONE_SEVERITY, OTHER_SEVERITY)


def worst(rank: dict[str, int], *levels: Column) -> Column:
    """Highest-ranked of several class columns, ignoring nulls; null when all are null."""
    top = F.greatest(*[choose(level, rank) for level in levels]) if len(levels) > 1 else choose(levels[0], rank)
    return choose(top, {v: k for k, v in rank.items()})
