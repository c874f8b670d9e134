import pytest
from pyspark.sql import functions as F

from rasterloom.functions import config, image, text
from rasterloom.operators import prompts, tiling


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_decode_and_numbers(spark):
    df = spark.createDataFrame([("añ".encode(),), ("añ".encode("latin-1"),)], "b binary")
    assert [r.v for r in df.select(text.decode_line(F.col("b")).alias("v")).collect()] == ["añ", "añ"]
    assert [one(spark, text.twelve_digits(F.lit(v))) for v in (0.0, 1.5, 100.0, -2.25)] == ["0", "1.5", "100", "-2.25"]
    assert one(spark, text.error_text(F.lit("failed"), F.lit("disk full"))) == "failed: disk full"


def test_causes_end_in_cycles():
    a, b = ValueError("a"), KeyError("b")
    a.__cause__, b.__cause__ = b, a
    assert len(text.causes(a)) == 2


@pytest.mark.parametrize(("manifest", "want"), [('{"class_names":["background","TarGet"]}', 1), ('{"class_names":["background","road"]}', None), ('{"class_names":["background","target"],"target_class_id":0}', None)])
def test_strict_class(spark, manifest, want):
    assert one(spark, config.strict_class_id(F.lit(manifest))) == want


def test_own_drafts(spark):
    rows = [("user_data/draft_user.gpkg", None, False), ("/tmp/draft_plugin.gpkg", None, True), ("/x/draft_session_1/a.gpkg|layername=draft", None, True), ("/x/a.gpkg", "1", True)]
    df = spark.createDataFrame(rows, "source string, marker string, want boolean")
    got = df.select(config.own_draft(F.col("source"), F.col("marker"), "/tmp").alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)


def test_small_expressions(spark):
    assert one(spark, config.base_name(F.lit("C:\\x\\scene.tif"))) == "scene"
    assert one(spark, config.crs_unit(F.lit('PROJCS["a",UNIT["degree",0.1],UNIT["Metre",1]]'))) == "metre"
    assert one(spark, config.unit_is_meter(F.lit(" Metre "))) and not one(spark, config.unit_is_meter(F.lit(None).cast("string")))
    assert one(spark, prompts.crop_scale(F.lit("abc"))) == 1.0 and one(spark, prompts.crop_scale(F.lit(99.0))) == 8.0
    assert abs(one(spark, image.softmax(F.array(F.lit(0.0), F.lit(1.0)), 1)) - 0.7310585786) < 1e-9
    with pytest.raises(ValueError):
        tiling.read_window(spark.range(1), None)
