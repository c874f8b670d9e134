"""Region algebra of drafts: user and inference areas as sets of grid cells, and versioned draft tables.

Areas are sets of cells of the reference grid, so union, difference and intersection are distinct, anti and semi
joins on (row, col). Exports live on the same grid; shapes off the grid are rasterised first (sub-cell area is lost).
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterloom.operators import components
from rasterloom.operators.ranking import global_rank

#: The draft's columns, origins, class, and attempts at a fusion.
DRAFT = "class_id int, class_name string, source_id int, feature_uuid string, origin string, run_id string"
CLASS_ID, CLASS_NAME, USER, INFERENCE, ATTEMPTS = 1, "target", "user", "inference", 3
KEY = ["row", "col"]


def cells_of(features: DataFrame, origin: str | None = None) -> DataFrame:
    rows = features if origin is None else features.filter(F.col("origin") == origin)
    return rows.select(*KEY).distinct()


def run_order(run_id: Column) -> Column:
    """Runs in order: by the name before a final number, then by that number, so r9 comes before r10."""
    digits = F.regexp_extract(run_id, r"(\d{1,18})$", 1)
    return F.struct(F.regexp_replace(run_id, r"\d{1,18}$", "").alias("name"), F.coalesce(digits.try_cast("long"), F.lit(-1)).alias("number"), run_id.alias("run_id"))


def compose(users: DataFrame, inference: DataFrame) -> DataFrame:
    """users and (inference - users): row, col, origin, run_id. Of several runs a cell keeps the latest: by a column
    run_at if inference has one, else by run_order."""
    mine = users.select(*KEY).distinct().select(*KEY, F.lit(USER).alias("origin"), F.lit(None).cast("string").alias("run_id"))
    latest = F.col("run_at") if "run_at" in inference.columns else run_order(F.col("run_id"))
    theirs = inference.groupBy(*KEY).agg(F.max_by("run_id", latest).alias("run_id")).join(mine.select(*KEY), KEY, "left_anti")
    return mine.unionByName(theirs.select(*KEY, F.lit(INFERENCE).alias("origin"), "run_id"))


def roi_merge(current: DataFrame, candidate: DataFrame, inside: Column, run_id: str) -> DataFrame:
    """Users stay; inference outside the region keeps its run, inside it is the candidate's under run_id; users win."""
    users = current.filter(F.col("origin") == USER)
    old = current.filter((F.col("origin") == INFERENCE) & ~inside).select(*KEY, "run_id")
    new = candidate.filter(inside).select(*KEY).distinct().withColumn("run_id", F.lit(run_id))
    return compose(users, old.unionByName(new))


def append_user(current: DataFrame, area: DataFrame) -> DataFrame:
    users = current.filter(F.col("origin") == USER).select(*KEY).unionByName(area.select(*KEY))
    return compose(users, current.filter(F.col("origin") == INFERENCE).select(*KEY, "run_id"))


def recompose(current: DataFrame) -> DataFrame:
    return append_user(current, current.limit(0))


def single_parts(area: DataFrame) -> DataFrame:
    """row, col, part: 4-connected parts of a set of cells (polygons touch only along edges)."""
    return components.label(area.select(*KEY).distinct(), 4).withColumnRenamed("label", "part")


def features_of(area: DataFrame, origin: str, run_id: str | None) -> DataFrame:
    """One feature per part: the draft's columns and its cells. uuid() differs each time: write before reuse."""
    parts = single_parts(area)
    found = parts.groupBy("part").agg(F.sort_array(F.collect_list(F.struct(*KEY))).alias("cells"))
    numbered = global_rank(found, ["part"], "source_id")
    return numbered.select(
        F.lit(CLASS_ID).alias("class_id"), F.lit(CLASS_NAME).alias("class_name"), "source_id", F.replace(F.uuid(), F.lit("-"), F.lit("")).alias("feature_uuid"),
        F.lit(origin).alias("origin"), F.lit(run_id if origin == INFERENCE else None).cast("string").alias("run_id"), "cells",
    )


def normalise(features: DataFrame, order: str, geometry: str = "cells", default_run: str | None = None) -> DataFrame:
    """Empty geometries go; unknown origins become user; source_id counts from 1 in order; a missing or repeated
    feature_uuid is renewed but for its first use; only inference carries a run."""
    kept = features.filter(F.col(geometry).isNotNull() & (F.size(geometry) > 0))
    origin = F.when(F.lower(F.trim("origin")) == INFERENCE, INFERENCE).otherwise(USER)
    use = F.row_number().over(Window.partitionBy("feature_uuid").orderBy(order))
    fresh = F.replace(F.uuid(), F.lit("-"), F.lit(""))
    out = kept.withColumn("_use", use).withColumn("_renew", F.col("feature_uuid").isNull() | (F.col("feature_uuid") == "") | (F.col("_use") > 1))
    out = global_rank(out.drop("source_id"), [order], "source_id").withColumn("origin", origin)
    out = out.withColumn("run_id", F.when(F.col("origin") == INFERENCE, F.coalesce(F.nullif("run_id", F.lit("")), F.lit(default_run))))
    return out.withColumn("feature_uuid", F.when(F.col("_renew"), fresh).otherwise(F.col("feature_uuid"))).drop("_use", "_renew")


def mark_changes(edited: DataFrame, snapshot: DataFrame, geometry: str = "wkb") -> DataFrame:
    """Features that are new, or whose geometry differs from the snapshot's, become user features without a run."""
    was = snapshot.groupBy("feature_uuid").agg(F.first(geometry).alias("_was"))
    joined = edited.join(was, "feature_uuid", "left")
    changed = F.col("_was").isNull() | (F.col("_was") != F.col(geometry))
    out = joined.withColumn("changed", changed).withColumn("origin", F.when(changed, USER).otherwise(F.col("origin")))
    return out.withColumn("run_id", F.when(~changed & (F.col("origin") == INFERENCE), F.col("run_id"))).drop("_was")


def public_columns(features: DataFrame) -> DataFrame:
    """What exports show."""
    return features.select("class_id", F.substring("class_name", 1, 80).alias("class_name"), "source_id")


def require_draft(features: DataFrame) -> DataFrame:
    missing = {c.split()[0] for c in DRAFT.split(", ")} - set(features.columns)
    if missing:
        raise ValueError(f"not a draft: {sorted(missing)} missing")
    return features


class DraftSession:
    """Versions of a draft as Parquet folders and a pointer; publishing writes a new version, then moves the pointer.

    The pointer is a small JSON file written through the cluster's file system, so any store will do: beside the old one,
    which it then replaces by renaming. A failed write leaves the old pointer, and so the current draft, untouched. A pointer
    that is there but cannot be read is an error, not an empty draft.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.state = self._read() or {"current": None, "exported": None, "undo": None, "last": 0}

    def _path(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/pointer.json")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _read(self) -> dict | None:
        fs, path = self._path()
        if not fs.exists(path):
            return None
        text = "\n".join(r[0] for r in self.spark.read.text(f"{self.folder}/pointer.json").collect())
        if not text.strip():
            return None if self._last() == 0 else {"current": self._last(), "exported": None, "undo": None, "last": self._last()}
        return json.loads(text)

    def _last(self) -> int:
        """The number of the last version that is written whole."""
        fs, path = self._path()
        parts = fs.globStatus(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/generation_*/_SUCCESS"))
        return max((int(p.getPath().getParent().getName().split("_")[1]) for p in parts), default=0)

    def _write(self, **change) -> None:
        state = self.state | change
        fs, path = self._path()
        jvm = self.spark.sparkContext._jvm
        beside = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/pointer.json.{uuid.uuid4().hex}.tmp")
        try:
            self._put(fs, beside, json.dumps(state).encode())
            option = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
            options = self.spark.sparkContext._gateway.new_array(option, 1)
            options[0] = option.OVERWRITE
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
            context.rename(fs.makeQualified(beside), fs.makeQualified(path), options)
        finally:
            fs.delete(beside, False)
        self.state = state

    @staticmethod
    def _put(fs, path, data: bytes) -> None:
        out = fs.create(path, True)
        out.write(bytearray(data))
        out.close()

    def version_path(self, version: int) -> str:
        return f"{self.folder}/generation_{version:04d}"

    @property
    def active(self) -> bool:
        return self.state["current"] is not None

    @property
    def dirty(self) -> bool:
        return self.state["current"] != self.state["exported"]

    def current(self) -> DataFrame:
        if not self.active:
            raise ValueError("no draft yet")
        return self.spark.read.parquet(self.version_path(self.state["current"]))

    def publish(self, draft: DataFrame, fusion: bool = False) -> int:
        """Write the next version and point to it. fusion keeps the version before for one undo; other edits end that."""
        version = self.state["last"] + 1
        draft.write.mode("overwrite").parquet(self.version_path(version))
        self._write(current=version, last=version, undo=self.state["current"] if fusion else None)
        return version

    def fuse(self, make, attempts: int = ATTEMPTS) -> int:
        """publish(make()) with retries; the draft stays as it was if all fail."""
        for left in reversed(range(attempts)):
            try:
                return self.publish(make(), fusion=True)
            except Exception:
                if not left:
                    raise
        raise AssertionError

    def undo_fusion(self) -> int:
        if self.state["undo"] is None:
            raise ValueError("no fusion to undo")
        self._write(current=self.state["undo"], undo=None)
        return self.state["current"]

    def mark_exported(self) -> None:
        self._write(exported=self.state["current"])

    def close(self) -> None:
        self._write(current=None, exported=None, undo=None)


def create_empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], DRAFT + ", cells array<struct<row:int,col:int>>")
