"""Model bundles' JSON: labels, classes, names, units, safe casts. Column expressions over raw JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rasterloom.operators.tiling import METERS

#: Fixed values of the formats.
LABEL_PATHS = ("$.class_names", "$.classes", "$.labels", "$._Attributes.labels")
#: Defaults of what an installation chooses: its models' framework and task, the wanted label and where a manifest states
#: its id, prefixes of a session's own folders and files.
FRAMEWORK, TASK, WANTED, ID_KEY = "torch", "segmentation", "target", "target_class_id"
DEFAULT_LABELS = ("background", WANTED)
SESSION_FOLDER, SESSION_FILE = "draft_session_", "draft_"
UNSAFE = "<>\\/:\";?*|=,`"


def clean_json(text: Column) -> Column:
    """Without a byte-order mark."""
    return F.regexp_replace(text, "^\\x{FEFF}", "")


def labels(manifest: Column, default: tuple[str, ...] = DEFAULT_LABELS) -> Column:
    found = [F.from_json(F.get_json_object(manifest, p), "array<string>") for p in LABEL_PATHS]
    return F.coalesce(*[F.when(F.size(x) > 0, x) for x in found], F.array(*[F.lit(x) for x in default]))


def valid_bundle(manifest: Column, framework: str = FRAMEWORK, task: str = TASK) -> Column:
    return F.coalesce((F.get_json_object(manifest, "$.framework") == framework) & (F.get_json_object(manifest, "$.task") == task), F.lit(False))


def display_name(manifest: Column, folder: Column) -> Column:
    paths = ("$.display_name", "$.name", "$.model_name")
    return F.coalesce(*[F.nullif(F.trim(F.get_json_object(manifest, p)), F.lit("")) for p in paths], folder)


def strict_class_id(manifest: Column, wanted: str = WANTED, id_key: str = ID_KEY) -> Column:
    """Position of the only label that equals wanted without case and outer space; null unless there is exactly one
    and a configured id agrees with it."""
    names = F.transform(F.from_json(F.get_json_object(manifest, "$.class_names"), "array<string>"), lambda x: F.lower(F.trim(x)))
    hits = F.size(F.filter(names, lambda x: x == wanted))
    at = F.array_position(names, F.lit(wanted)).cast("int") - 1
    stated = F.get_json_object(manifest, f"$.{id_key}")
    return F.when((hits == 1) & (stated.isNull() | (stated.try_cast("int") == at)), at)


def lenient_class_id(manifest: Column, wanted: str = WANTED, id_key: str = ID_KEY) -> Column:
    names = F.transform(labels(manifest), lambda x: F.lower(F.trim(x)))
    at = F.array_position(names, F.lit(wanted)).cast("int")
    return F.coalesce(F.get_json_object(manifest, f"$.{id_key}").try_cast("int"), F.when(at > 0, at - 1), F.when(F.size(names) > 1, 1).otherwise(0))


def safe_int(value: Column, default: int) -> Column:
    return F.coalesce(value.try_cast("int"), F.lit(default))


def class_name(class_id: Column, wanted: str = WANTED) -> Column:
    return F.when(class_id == 0, "background").when(class_id == 1, wanted).otherwise(class_id.cast("string"))


def colour_index(class_id: Column, size: int = 10) -> Column:
    return F.pmod(class_id, F.lit(size))


def is_background(name: Column) -> Column:
    return F.lower(F.trim(name)) == "background"


def layer_name(name: Column, default: str = WANTED) -> Column:
    """A DXF layer name: unsafe characters become _, at most 80."""
    pattern = "[" + "".join("\\" + c for c in UNSAFE) + "]"
    return F.substring(F.coalesce(F.nullif(F.regexp_replace(F.trim(name), pattern, "_"), F.lit("")), F.lit(default)), 1, 80)


def base_name(path: Column, default: str = "result") -> Column:
    """File name without folder and extension."""
    return F.coalesce(F.nullif(F.regexp_replace(F.element_at(F.split(F.regexp_replace(path, "\\\\", "/"), "/"), -1), "\\.[^.]*$", ""), F.lit("")), F.lit(default))


def source_path(uri: Column) -> Column:
    """The part before the first | of a layer address."""
    return F.split_part(uri, F.lit("|"), F.lit(1))


def unit_is_meter(unit: Column) -> Column:
    return F.coalesce(F.lower(F.trim(unit)).isin(*sorted(METERS)), F.lit(False))


def crs_unit(wkt: Column) -> Column:
    """The name in the last UNIT of a well-known text, in lower case."""
    found = F.regexp_extract_all(wkt, F.lit(r'UNIT\["([^"]+)"'), F.lit(1))
    return F.lower(F.when(F.size(found) > 0, F.element_at(found, -1)))


def is_georeferenced(wkt: Column, transform: Column) -> Column:
    """A reference system, or a transform other than the default one."""
    t = transform
    plain = (t["a"] == 1) & (t["b"] == 0) & (t["c"] == 0) & (t["d"] == 0) & (F.abs(t["e"]) == 1) & (t["f"] == 0)
    return (F.length(F.coalesce(wkt, F.lit(""))) > 0) | ~F.coalesce(plain, F.lit(True))


def merge_json(base: Column, override: Column) -> Column:
    """Two maps of JSON text merged: the second wins, entry by entry."""
    kept = F.map_filter(base, lambda k, _: ~F.map_contains_key(override, k))
    return F.map_concat(kept, override)


def own_draft(source: Column, marker: Column, temp_root: str, session_folder: str = SESSION_FOLDER, session_file: str = SESSION_FILE) -> Column:
    """A session's own layer: marked, or in a session folder, or named so in the temp root itself."""
    parts = F.split(F.regexp_replace(source_path(source), "\\\\", "/"), "/")
    folder, name = F.coalesce(F.get(parts, F.size(parts) - 2), F.lit("")), F.element_at(parts, -1)
    parent = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), "/")
    return (F.coalesce(marker, F.lit("")) == "1") | F.startswith(folder, F.lit(session_folder)) | (F.startswith(name, F.lit(session_file)) & (parent == temp_root.rstrip("/")))
