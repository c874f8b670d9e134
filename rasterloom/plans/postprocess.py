"""The whole post-processing plan: threshold, morphology, components, zonal rules, class raster, audit."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.operators import components, rules, stats, stencil
from rasterloom.operators.tiling import BLOCK, Affine, is_meter
from rasterloom.session import materialize

#: Defaults of the stages.
DEFAULTS = {"threshold": 0.5, "morph_closing": False, "morph_close_size": 5, "fill_holes": False, "max_hole_area_m2": 0.0, "smooth_boundary": False, "smooth_size": 3, "morph_opening": True, "morph_open_size": 3, "min_area_m2": 500.0}
#: Other names of the same settings, and the document's version marks.
ALIASES = {"prob_threshold": "threshold", "closing_size": "morph_close_size", "smooth_boundary_size": "smooth_size", "opening_size": "morph_open_size"}
CONTRACT, METHOD = "explicit_dem_factors_v3", "streaming_histogram_10000_bins"
STAGE_NAMES = {"threshold": "threshold_pixel_count", "closing": "post_closing_pixel_count", "fill": "post_fill_holes_pixel_count", "smooth": "post_smooth_pixel_count", "opening": "post_opening_pixel_count"}


def settings(config: dict) -> dict:
    """Defaults under the config; an alias counts where the setting's own name is not given; sizes are whole numbers of at
    least 1, and a size that no stage reads is an error."""
    unknown = {k for k in config if k.endswith("_size")} - {*DEFAULTS, *ALIASES}
    if unknown:
        raise ValueError(f"no stage reads {sorted(unknown)}")
    out = DEFAULTS | {ALIASES[k]: v for k, v in config.items() if k in ALIASES} | {k: v for k, v in config.items() if k not in ALIASES}
    return out | {k: max(1, int(out[k])) for k in ("morph_close_size", "smooth_size", "morph_open_size")}


@dataclass
class Result:
    mask: DataFrame
    stages: list[tuple[str, DataFrame]]
    labels: DataFrame
    decisions: DataFrame
    class_raster: DataFrame


def merged(base: dict, overrides: dict | None) -> dict:
    """Overrides one level deep: a nested object replaces entry by entry, its own members whole."""
    out = dict(base)
    for k, v in (overrides or {}).items():
        out[k] = {**out[k], **v} if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def masks(pixels: DataFrame, config: dict, width: int, height: int, pixel_area: float = 1.0, block: int = BLOCK) -> list[tuple[str, DataFrame]]:
    """(stage, mask) in order; a disabled stage repeats the mask before it. pixels: row, col, p[, valid], dense."""
    c = settings(config)
    valid = F.coalesce(F.col("valid"), F.lit(False)) if "valid" in pixels.columns else F.lit(True)
    now = pixels.select("row", "col", (stats.above(F.col("p"), c["threshold"]) & valid).cast("int").alias("m"), valid.alias("valid"))
    out = [("threshold", now)]
    if c["morph_closing"]:
        now = stencil.closing(now, c["morph_close_size"])
    out.append(("closing", now))
    if c["fill_holes"]:
        now = materialize(now, "mask-closed")
        now = materialize(components.fill_holes(now, components.hole_limit(c["max_hole_area_m2"], pixel_area), width, height, block), "mask-filled")
    out.append(("fill", now))
    if c["smooth_boundary"]:
        now = stencil.smooth(now, c["smooth_size"])
    out.append(("smooth", now))
    if c["morph_opening"]:
        now = stencil.opening(now, c["morph_open_size"])
    out.append(("opening", now))
    return out


def stage_counts(stages: list[tuple[str, DataFrame]]) -> DataFrame:
    frames = [m.agg(F.sum(F.col("m").cast("long")).alias("pixels")).select(F.lit(name).alias("stage"), "pixels") for name, m in stages]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def run(pixels: DataFrame, factors: DataFrame | None, filled: DataFrame | None, config: dict, width: int, height: int, pixel_area: float = 1.0, block: int = BLOCK) -> Result:
    """Factors are joined only if a rule is enabled. block: side of the tiles in which components are labelled."""
    stages = masks(pixels, config, width, height, pixel_area, block)
    mask = stages[-1][1]
    labels = materialize(components.label(mask.filter("m = 1").select("row", "col"), 8, block), "labels")
    enabled = rules.ordered_rules(config) if config.get("rules") else []
    if enabled and factors is not None:
        zones = rules.zonal_stats(labels, factors, filled, sorted({r["factor"] for r in enabled}), sorted({r["stat"] for r in enabled}))
    else:
        zones = labels.groupBy("label").agg(F.count("*").alias("pixel_count")).withColumn("dem_fill_fraction", F.lit(0.0))
    ids = components.records(labels, width, height).select("label", "comp_id")
    decisions = materialize(rules.decide(zones, config if enabled else config | {"rules": {}, "rule_order": []}, pixel_area).join(ids, "label"), "decisions")
    kept = decisions.filter("decision = 'keep'").select("label")
    on = labels.join(kept, "label", "left_semi").select("row", "col", F.lit(1).alias("value"))
    raster = pixels.select("row", "col").join(on, ["row", "col"], "left").withColumn("value", F.coalesce("value", F.lit(0)))
    return Result(mask, stages, labels, decisions, raster)


def audit_summary(result: Result, config: dict) -> DataFrame:
    """One row: how many components there are, are kept and dropped, pixels after each stage, and the settings."""
    c, kept = settings(config), F.count_if(F.col("decision") == "keep")
    out = result.decisions.agg(F.count("*").alias("component_count"), kept.alias("kept"), (F.count("*") - kept).alias("dropped"))
    counts = stage_counts(result.stages).agg(*[F.max(F.when(F.col("stage") == k, F.col("pixels"))).alias(v) for k, v in STAGE_NAMES.items()])
    return out.crossJoin(F.broadcast(counts)).withColumns({"threshold": F.lit(float(c["threshold"])), "min_area_m2": F.lit(float(c["min_area_m2"])), "prob_stats_method": F.lit(METHOD)})


def audit_document(result: Result, summary: DataFrame | None = None) -> DataFrame:
    """One JSON line per component in comp_id order, and the summary: written apart, so no array of all components is
    ever gathered in a task."""
    columns = ["comp_id", "pixel_count", "area_m2", "threshold", "rule_evaluations", "dem_fill_fraction", "decision", "rule", "rules_skipped"]
    named = result.decisions.withColumn("rule", F.when(F.col("rule") == "min_area_m2", "min_area").otherwise(F.col("rule")))
    named = named.withColumn("rules_skipped", F.when(F.col("rules_skipped").isNotNull(), "dem_fill_fraction_gt_0.5"))
    return named.orderBy("comp_id").select(F.to_json(F.struct(*columns)).alias("value"))


def write_audit(result: Result, config: dict, pixels: DataFrame, path: str, runtime: dict | None = None) -> dict:
    """Write the document under path: summary (one JSON object) and components (JSON lines in comp_id order). Returns
    the summary. runtime: runtime_resolution, resolution_warnings and inference, as the caller knows them."""
    spark, c, known = pixels.sparkSession, settings(config), runtime or {}
    numbers = audit_summary(result, config).first().asDict()
    probability = stats.probability_stats(pixels, c["threshold"]).first().asDict()
    percents = {f"p{r['percent']}": r["value"] for r in stats.histogram_percentiles(stats.probability_histogram(pixels)).collect()}
    rules_ = config.get("rules") or {}
    summary = {
        "schema_version": int(config.get("schema_version", 1)), "contract": CONTRACT, "dem_factors": config.get("dem_factors"), "training_data": config.get("training_data"),
        "runtime_resolution": known.get("runtime_resolution", {}), "resolution_warnings": known.get("resolution_warnings", []), "inference": known.get("inference"),
        "rules": rules_, "rule_order": config.get("rule_order", list(rules_)), "prob_stats": {k: probability[k] for k in ("min", "max", "mean")} | percents, **numbers,
    }
    audit_document(result).write.mode("overwrite").text(f"{path}/components")
    spark.createDataFrame([(json.dumps(summary, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/summary")
    return summary


def runtime_metadata(config: dict, image: Affine, image_unit: str | None, dem: dict | None) -> dict:
    """Resolutions at run time (null where the unit is no meter) and warnings where one differs from the training data's by
    more than a quarter. dem: resolution and crs_unit of the elevation, as far as known."""
    known = {"image": image.resolution if is_meter(image_unit) else None, "dem": (dem or {}).get("resolution")}
    out = {"image_resolution_m": known["image"], "image_crs_unit": image_unit, "dem_resolution_m": known["dem"], "dem_crs_unit": (dem or {}).get("crs_unit")}
    warnings = []
    for kind, here in known.items():
        trained = float(config["training_data"][f"{kind}_resolution_m"])
        if here is not None and trained > 0 and (off := abs(here - trained) / trained) > 0.25:
            warnings.append({"kind": f"{kind}_resolution_mismatch", "runtime_resolution_m": float(here), "training_resolution_m": trained, "relative_difference": off})
    return {"runtime_resolution": out, "resolution_warnings": warnings}


def run_from_file(spark: SparkSession, path: str, progress: Callable[[str, float], None] | None = None) -> dict:
    """The whole plan from a file of parameters (one JSON object): pixels, and where given factors and filled (Parquet
    folders), config (an object), width, height, transform (six numbers), unit, output (a folder). Writes output/raster and
    output/audit and returns the audit's summary. progress(stage, percent) is called as each part ends."""
    params = json.loads("\n".join(r[0] for r in spark.read.text(path).collect()).lstrip("\ufeff"))
    if missing := {"pixels", "config", "width", "height", "output"} - params.keys():
        raise ValueError(f"parameters missing: {sorted(missing)}")
    tell = progress or (lambda stage, percent: None)
    read = lambda name: spark.read.parquet(params[name]) if params.get(name) else None
    transform, config = Affine(*params.get("transform", ())), params["config"]
    pixels = read("pixels")
    tell("load", 8.0)
    result = run(pixels, read("factors"), read("filled"), config, int(params["width"]), int(params["height"]), transform.pixel_area)
    tell("postprocess", 88.0)
    result.class_raster.write.mode("overwrite").parquet(f"{params['output']}/raster")
    tell("write", 98.0)
    runtime = runtime_metadata(config, transform, params.get("unit"), params.get("dem")) if config.get("training_data") else None
    summary = write_audit(result, config, pixels, f"{params['output']}/audit", runtime)
    tell("audit", 100.0)
    return summary


def in_memory(pixels: DataFrame, config: dict, width: int, height: int, pixel_area: float = 1.0, limit: int = 16 * 1024 * 1024) -> tuple[Result, DataFrame]:
    """The path for small rasters with its own rules: more than `limit` pixels are refused, percentiles are exact, and a
    hole limit of 0 fills every hole. (result, percentiles)."""
    if width * height > limit:
        raise ValueError(f"{width} x {height} pixels are over {limit}: use run()")
    area = float(settings(config)["max_hole_area_m2"])
    whole = config | ({"max_hole_area_m2": width * height * pixel_area} if area == 0 else {})
    return run(pixels, None, None, whole | {"rules": {}, "rule_order": []}, width, height, pixel_area), stats.exact_percentiles(pixels)
