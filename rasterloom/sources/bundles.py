"""Catalog of model bundles and their configuration."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.functions import config
from rasterloom.operators import rules

#: Models and factor functions are registered, never imported from a bundle's folder.
MODELS: dict[str, Callable[[dict], Callable]] = {}
FACTOR_FUNCTIONS: dict[str, tuple[tuple[str, ...], Callable]] = {}


def register_model(name: str):
    def put(factory):
        MODELS[name] = factory
        return factory

    return put


def register_factors(name: str, names: tuple[str, ...]):
    def put(fn):
        FACTOR_FUNCTIONS[name] = (names, fn)
        return fn

    return put


def scan(spark: SparkSession, root: str) -> DataFrame:
    """name, path, manifest of folders below root with a valid manifest.json, by path; broken ones are left out."""
    found = spark.read.text(f"{root.rstrip('/')}/*/manifest.json", wholetext=True).select(F.input_file_name().alias("file"), config.clean_json(F.col("value")).alias("manifest"))
    folder = F.regexp_replace("file", "/manifest\\.json$", "")
    good = found.filter(F.try_parse_json("manifest").isNotNull() & config.valid_bundle(F.col("manifest")))
    return good.select(config.display_name(F.col("manifest"), F.element_at(F.split(folder, "/"), -1)).alias("name"), folder.alias("path"), F.lit(config.FRAMEWORK).alias("backend"), "manifest").orderBy("path")


def read_json(path: str, default: dict | None = None) -> dict:
    """A small configuration file, with or without byte-order mark; default {} where there is none."""
    p = Path(path)
    return json.loads(p.read_text("utf-8-sig")) if p.exists() else dict(default or {})


@dataclass(frozen=True)
class Bundle:
    path: str
    manifest: dict
    preprocess: dict = field(default_factory=dict)
    postprocess: dict = field(default_factory=dict)

    @property
    def model_config(self) -> dict:
        return self.manifest.get("model_config") or self.manifest.get("model") or self.manifest

    @property
    def weights(self) -> str:
        return str(Path(self.path) / self.manifest.get("weights", "weights.npz"))

    @property
    def input_mode(self) -> str:
        """dual, concat or image."""
        stated = self.manifest.get("input_mode") or self.manifest.get("model_input")
        if stated in ("dual", "concat", "image"):
            return stated
        return "dual" if self.manifest.get("dem_in_channels") else "image"

    def channels(self) -> list[str]:
        names = list(self.postprocess.get("dem_factors", {}))
        wanted = int(self.manifest.get("dem_in_channels", len(names)))
        if wanted > len(names):
            raise ValueError(f"{wanted} elevation channels asked for, {len(names)} factors known")
        return names[:wanted]

    def settings(self, *extras: dict) -> dict:
        out: dict = {}
        for part in (self.manifest, self.preprocess, self.postprocess, *extras):
            out |= part
        return out


def load(path: str) -> Bundle:
    root = Path(path)
    if not (root / "manifest.json").exists():
        raise FileNotFoundError(f"{path}: no manifest.json")
    b = Bundle(path, read_json(str(root / "manifest.json")), read_json(str(root / "preprocess.json")), read_json(str(root / "postprocess.json")))
    if b.postprocess:
        rules.check_contract(b.postprocess)
    return b


def strip_prefix(state: dict, prefix: str = "module.") -> dict:
    """Weights by name; of a checkpoint its state table; without the prefix of wrapped models."""
    for k in ("state_dict", "model_state_dict", "model"):
        if isinstance(state.get(k), dict):
            state = state[k]
            break
    return {k.removeprefix(prefix): v for k, v in state.items()}
