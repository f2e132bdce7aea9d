"""Who has to act on which zone, and in which order to tell them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from freshet.functions.ordering import global_ordinal
from freshet.functions.risk import SEVERITY_RANK, choose
from freshet.operators.alerts import half_even, text
from freshet.operators.zones import NEAR_KM, near_zones
from freshet.session import materialize

# Tiers, their margins beyond the zone edge, list lengths, actions and texts.
STAY_AWAY_KM, DIVERT_KM = 1.0, 3.0
STAY_AWAY_ZONES, DIVERT_ZONES, MONITOR_ZONES = 3, 2, 1
PRIORITIES = ("P0", "P1", "P2", "P3", "NONE")
DISPATCH_ORDER = {"P0": 1, "P1": 2, "P2": 3, "P3": 4}
ACTION = {"P0": "EVACUATE", "P1": "STAY_AWAY", "P2": "DIVERT", "P3": "MONITOR", "NONE": "NO_ACTION"}
P0_MESSAGE = "EMERGENCY: You are inside a %s hazard zone. Evacuate immediately."
P1_MESSAGE = "WARNING: Hazard zone %.1fkm away. Stay away from the area."
P2_MESSAGE = "CAUTION: Hazard zone %.1fkm away. Consider alternate routes."
P3_MESSAGE = "ADVISORY: Hazard activity in region. Monitor official updates."
P0_REASON = "User location inside hazard zone"
P1_REASON = "User within 1km of zone edge"
P2_REASON = "User within 3km of zone edge"
P3_REASON = "User within buffer zone (%.1fkm)"
NO_REASON = "User outside all hazard zones and buffers"
WAVE_MESSAGE = " [Evacuation Wave %d]"
WAVES = 3
MAX_EVACUEES = 100


def user_priority(
    users: DataFrame,
    zones: DataFrame,
    buffer_km: float = NEAR_KM,
    key: Sequence[str] = ("user_id",),
    lexical_severity: bool = False,
    valid_at: str | None = None,
) -> DataFrame:
    """One decision per user. The nearest zone is the one with the nearest centre; ties go by zone_id.

    Users near no zone, or when there are no zones at all, get a NONE row. With `valid_at`, a column of
    `users`, only zones whose `valid_until` lies after that time count for a user.
    """
    pairs = near_zones(users, zones, buffer_km, key, "left", valid_at=valid_at)
    inside = F.coalesce(F.col("is_inside"), F.lit(False))
    order = W.partitionBy(*key).orderBy(F.col("distance_km").asc_nulls_last(), "zone_id")
    ranked = pairs.withColumn("_rank", F.row_number().over(order))
    near = F.struct("_rank", "zone_id", "distance_km", "radius_km")
    rank = choose(F.col("severity"), SEVERITY_RANK)
    worst_inside = (
        F.max(F.when(inside, F.col("severity")))
        if lexical_severity
        else choose(F.max(F.when(inside, rank)), {v: k for k, v in SEVERITY_RANK.items()})
    )
    listed = F.col("zone_id").isNotNull() & (F.col("_rank") <= STAY_AWAY_ZONES)
    # the inside list is a field of the decision itself; the near list is pruned to its k first
    grouped = ranked.groupBy(*users.columns).agg(
        F.sort_array(F.collect_list(F.when(inside, F.col("zone_id")))).alias("_inside"),
        F.sort_array(F.collect_list(F.when(listed, near))).alias("_near"),
        worst_inside.alias("_worst"),
    )
    nearest = F.try_element_at("_near", F.lit(1))
    grouped = grouped.withColumns(
        {"_km": nearest["distance_km"], "_edge": nearest["radius_km"], "_ids": F.transform("_near", lambda n: n["zone_id"])}
    )
    priority = (
        F.when(F.size("_inside") > 0, "P0")
        .when(F.col("_km") <= F.col("_edge") + STAY_AWAY_KM, "P1")
        .when(F.col("_km") <= F.col("_edge") + DIVERT_KM, "P2")
        .when(F.col("_km").isNotNull(), "P3")
        .otherwise("NONE")
    )
    p, km = F.col("priority"), half_even(F.col("_km"), 1)

    def per_tier(p0, p1, p2, p3, none):
        return F.when(p == "P0", p0).when(p == "P1", p1).when(p == "P2", p2).when(p == "P3", p3).otherwise(none)

    return grouped.withColumn("priority", priority).select(
        *users.columns,
        (p != "NONE").alias("should_alert"),
        "priority",
        choose(p, ACTION).alias("action"),
        per_tier(
            F.col("_inside"),
            F.slice("_ids", 1, STAY_AWAY_ZONES),
            F.slice("_ids", 1, DIVERT_ZONES),
            F.slice("_ids", 1, MONITOR_ZONES),
            F.array().cast("array<string>"),
        ).alias("zones"),
        per_tier(
            text(P0_MESSAGE, F.col("_worst")), text(P1_MESSAGE, km), text(P2_MESSAGE, km), F.lit(P3_MESSAGE), F.lit("")
        ).alias("message"),
        per_tier(F.lit(P0_REASON), F.lit(P1_REASON), F.lit(P2_REASON), text(P3_REASON, km), F.lit(NO_REASON)).alias("reason"),
    )


def priority_counts(decisions: DataFrame) -> DataFrame:
    """Users per tier, tiers without users included."""
    counts = decisions.groupBy().agg(*[F.count_if(F.col("priority") == p).alias(p) for p in PRIORITIES])
    return counts.unpivot([], list(PRIORITIES), "priority", "users")


def evacuation_waves(decisions: DataFrame, order: Sequence[str], limit: int = MAX_EVACUEES) -> DataFrame:
    """When more than `limit` users must evacuate, spread them round-robin over three waves."""
    decisions = materialize(decisions)  # read twice below
    evacuees = decisions.where(F.col("priority") == "P0")
    others = decisions.where(F.col("priority") != "P0")
    numbered = global_ordinal(evacuees, [*order], "_n", total="_total")
    wave = F.when(F.col("_total") > limit, (F.col("_n") % WAVES + 1).cast("int"))
    called = F.concat("message", text(WAVE_MESSAGE, F.col("wave")))
    waved = (
        numbered.withColumn("wave", wave)
        .withColumn("message", F.when(F.col("wave").isNotNull(), called).otherwise(F.col("message")))
        .drop("_n", "_total")
    )
    return waved.unionByName(others.withColumn("wave", F.lit(None).cast("int")))


def dispatch_queue(decisions: DataFrame, order: Sequence[str]) -> DataFrame:
    """Alerts to send, most urgent tier first, input order inside a tier."""
    return (
        decisions.where(F.col("priority") != "NONE")
        .withColumn("dispatch_order", choose(F.col("priority"), DISPATCH_ORDER))
        .orderBy("dispatch_order", *order)
    )


def alerts_by_priority(decisions: DataFrame, order: Sequence[str]) -> DataFrame:
    rank = choose(F.col("priority"), DISPATCH_ORDER, len(DISPATCH_ORDER) + 1)
    return decisions.withColumn("rank", rank).orderBy("rank", *order)
