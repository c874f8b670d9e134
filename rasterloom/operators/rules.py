"""Contracts, zonal statistics and the ordered rule cascade over components."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.operators.dem import FACTORS, METHODS
from rasterloom.operators.stats import finite

#: Fixed values of the contract.
RULE_KEYS = {"slope": "slope_min_deg", "relief": "relief_min_m", "tpi": "tpi_max_ridge"}
STATS = ("median", "mean", "min", "max")
OPERATORS = (">=", ">", "<=", "<")
MIN_AREA, MAX_FILLED = 500.0, 0.5
EVALUATION = "struct<rule:string,factor:string,stat:string,operator:string,threshold_value:double,observed_value:double,passed:boolean>"


def _mapping(value, what: str) -> dict:
    if not isinstance(value, dict):
        raise ValueError(f"{what} must be an object")
    return value


def _number(value, what: str) -> float:
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise ValueError(f"{what} must be a number")
    return float(value)


def check_factors(config: dict, names: Iterable[str] | None = None) -> None:
    """Names, order and methods of the factors; tpi and relief need a metric window."""
    stated = _mapping(config.get("dem_factors"), "dem_factors")
    if tuple(stated) != FACTORS or names is not None and tuple(names) != FACTORS:
        raise ValueError(f"factors must be {FACTORS} in this order")
    for name, entry in stated.items():
        if _mapping(entry, name).get("method") != METHODS[name]:
            raise ValueError(f"{name}: method must be {METHODS[name]}")
        if name in ("tpi", "relief"):
            if entry.get("scale_mode") != "meters" or entry.get("unit") != "m" or _number(entry.get("window_m"), f"{name}.window_m") <= 0:
                raise ValueError(f"{name}: a window in meters is needed")


def check_training(config: dict) -> None:
    stated = _mapping(config.get("training_data"), "training_data")
    for k in ("image_resolution_m", "dem_resolution_m"):
        if _number(stated.get(k), k) <= 0:
            raise ValueError(f"{k} must be positive")
    if stated.get("crs_unit") != "m":
        raise ValueError("training_data.crs_unit must be m")


def check_rules(config: dict) -> None:
    """Every rule is checked, disabled ones too; the order is a permutation of the names."""
    rules = _mapping(config.get("rules"), "rules")
    order = config.get("rule_order")
    if not rules or not isinstance(order, list) or sorted(order) != sorted(rules):
        raise ValueError("rule_order must name every rule once")
    factors = _mapping(config.get("dem_factors"), "dem_factors")
    for name, rule in rules.items():
        if name not in RULE_KEYS:
            raise ValueError(f"unknown rule {name}")
        if not isinstance(_mapping(rule, name).get("enabled"), bool) or rule.get("factor") not in factors or rule.get("stat") not in STATS or rule.get("operator") not in OPERATORS:
            raise ValueError(f"{name}: enabled, factor, stat and operator are needed")
        _number(rule.get(RULE_KEYS[name]), f"{name}.{RULE_KEYS[name]}")


def check_contract(config: dict, names: Iterable[str] | None = None) -> None:
    check_factors(config, names)
    check_training(config)
    check_rules(config)


def require_metric(config: dict, unit: str | None) -> None:
    from rasterloom.operators.tiling import is_meter

    if any(f.get("scale_mode") == "meters" for f in config["dem_factors"].values()) and not is_meter(unit):
        raise ValueError("factors in meters need a metric reference system")


def ordered_rules(config: dict, enabled_only: bool = True) -> list[dict]:
    """Rules in their order, with the threshold looked up by the rule's own key."""
    order = config.get("rule_order") or list(config.get("rules", {}))
    out = [{"rule": n, **{k: config["rules"][n][k] for k in ("factor", "stat", "operator", "enabled")}, "threshold_value": float(config["rules"][n][RULE_KEYS[n]])} for n in order]
    return [r for r in out if r["enabled"]] if enabled_only else out


def rules_summary(config: dict) -> dict[str, dict]:
    """What an audit shows of each rule, disabled ones too."""
    return {r["rule"]: {"enabled": bool(r["enabled"]), "factor": r["factor"], "stat": r["stat"], "operator": r["operator"], "threshold_key": RULE_KEYS[r["rule"]], "threshold_value": r["threshold_value"]} for r in ordered_rules(config, False)}


def zonal_stats(labels: DataFrame, factors: DataFrame, filled: DataFrame | None, columns: Iterable[str] = FACTORS, stats: Iterable[str] = STATS) -> DataFrame:
    """label, pixel_count, dem_fill_fraction, and <factor>_<stat> over finite values. One co-partitioned join on the
    pixel, one aggregation; tiles without a component never enter because labels are sparse."""
    columns, stats = list(columns), list(stats)
    joined = labels.join(factors.select("row", "col", *[finite(F.col(c).cast("double")).alias(c) for c in columns]), ["row", "col"], "left")
    if filled is not None:
        joined = joined.join(filled.select("row", "col", "dem_filled"), ["row", "col"], "left")
    how = {"median": F.median, "mean": F.avg, "min": F.min, "max": F.max}
    observed = [how[s](c).alias(f"{c}_{s}") for c in columns for s in stats]
    share = F.sum(F.col("dem_filled").cast("int")) / F.greatest(F.lit(1), F.count("*")) if filled is not None else F.lit(0.0)
    return joined.groupBy("label").agg(F.count("*").alias("pixel_count"), F.coalesce(share, F.lit(0.0)).alias("dem_fill_fraction"), *observed)


def compare(observed: Column, operator: str, threshold: float) -> Column:
    """Null fails."""
    op = {">=": observed >= threshold, ">": observed > threshold, "<=": observed <= threshold, "<": observed < threshold}
    if operator not in op:
        raise ValueError(f"unknown operator {operator}")
    return F.coalesce(op[operator], F.lit(False))


def decide(zones: DataFrame, config: dict, pixel_area: float = 1.0) -> DataFrame:
    """Adds area_m2, rule_evaluations, decision, rule, threshold, rules_skipped.

    In order: an area below min_area_m2 drops; mostly filled elevation (over half) keeps with rules_skipped; else
    enabled rules run in order and the first failure drops, ending the list of evaluations; else keep.
    """
    min_area = float(config.get("min_area_m2", MIN_AREA))
    rules = ordered_rules(config)
    evaluations = [
        F.struct(
            F.lit(r["rule"]).alias("rule"), F.lit(r["factor"]).alias("factor"), F.lit(r["stat"]).alias("stat"), F.lit(r["operator"]).alias("operator"), F.lit(r["threshold_value"]).alias("threshold_value"),
            F.col(f"{r['factor']}_{r['stat']}").alias("observed_value"), compare(F.col(f"{r['factor']}_{r['stat']}"), r["operator"], r["threshold_value"]).alias("passed"),
        )
        for r in rules
    ]
    every = F.array(*evaluations).cast(f"array<{EVALUATION}>") if evaluations else F.array().cast(f"array<{EVALUATION}>")
    out = zones.withColumn("area_m2", F.col("pixel_count") * F.lit(float(pixel_area))).withColumn("_all", every)
    out = out.withColumn("_fail", F.array_position(F.transform("_all", lambda e: e["passed"]), F.lit(False)).cast("int"))
    small, skipped = F.col("area_m2") < min_area, F.col("dem_fill_fraction") > MAX_FILLED
    failed = ~small & ~skipped & (F.col("_fail") > 0)
    out = out.withColumn("rule_evaluations", F.when(small | skipped, F.array().cast(f"array<{EVALUATION}>")).when(failed, F.slice("_all", F.lit(1), F.col("_fail"))).otherwise(F.col("_all")))
    out = out.withColumn("decision", F.when(small | failed, "drop").otherwise("keep"))
    last = F.element_at(F.when(failed, F.col("rule_evaluations")), -1)
    out = out.withColumn("rule", F.when(small, "min_area_m2").when(failed, last["rule"]))
    out = out.withColumn("threshold", F.when(small, F.lit(min_area)).when(failed, last["threshold_value"]))
    return out.withColumn("rules_skipped", F.when(~small & skipped, "dem_fill_fraction")).drop("_all", "_fail")


def resolution_warning(kind: str, runtime: Column, training: float) -> Column:
    """A struct where resolutions differ by more than a quarter, else null."""
    off = F.abs(runtime - training) / training
    return F.when(off > 0.25, F.struct(F.lit(f"{kind}_resolution").alias("kind"), runtime.alias("runtime"), F.lit(training).alias("training"), off.alias("relative_difference")))
