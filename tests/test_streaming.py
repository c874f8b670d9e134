import numpy as np
import pytest

from rasterloom.plans import inference
from rasterloom.streaming import protocol, sessions


def test_event_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "log.txt").write_text('noise\nEVENT {"type":"progress","stage":"predict","current":5,"total":10}\nEVENT {broken\n')
    q = protocol.event_stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("ev").start()
    try:
        q.processAllAvailable()
        rows = spark.sql("select * from ev").collect()
    finally:
        q.stop()
    assert [(r.type, r.stage, r.current) for r in rows] == [("progress", "predict", 5.0)]


def test_session_stream(spark, tmp_path):
    schema = "session_id string, seq long, op string, message string"
    ops = [("s", 1, "predict", None), ("s", 2, "init", None), ("s", 3, "set_image", '{"image":"i"}'), ("s", 4, "predict", '{"positive":[[5,5]]}'), ("s", 5, "predict", '{"positive":[[5,5],[6,6]]}'), ("s", 6, "nonsense", None), ("s", 7, "predict", "{bad"), ("s", 8, "predict", '{"positive":[[9000,5]]}')]
    batch = {r.seq: r for r in sessions.run(spark.createDataFrame(ops, schema)).collect()}
    assert [batch[i].ok for i in range(1, 9)] == [False, True, True, True, True, False, False, True]
    assert '"refined": true' in batch[5].detail and '"refined": false' in batch[8].detail
    spark.createDataFrame(ops[:4], schema).coalesce(1).write.json(str(tmp_path / "in" / "a"))
    stream = spark.readStream.schema(schema).json(str(tmp_path / "in" / "*"))

    def drain():
        # without a timeout, which keeps a query busy, a run ends once its input is read; state lives on between runs
        q = sessions.run(stream, timeout_ms=None).writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        try:
            assert q.awaitTermination(60)
        finally:
            q.stop()

    drain()
    spark.createDataFrame(ops[4:5], schema).coalesce(1).write.json(str(tmp_path / "in" / "b"))
    drain()
    rows = {r.seq: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert len(rows) == 5 and '"refined": true' in rows[5].detail


def test_diagnostics_bounds(spark):
    lines = spark.createDataFrame([("k", i, f"line {i % 300}") for i in range(600)], "k string, i int, line string")
    got = protocol.diagnostics_report(protocol.diagnostics(lines, ["k"], "i"), ["k"]).first()
    assert (got.kept, got.repeats, got.dropped) == (256, 300, 44)


def test_model_inputs_and_padding():
    image, factors = np.zeros((3, 20, 18)), np.stack([np.full((20, 18), i) for i in range(5)])
    assert inference.assemble(image, factors, "concat").shape == (8, 20, 18)
    assert inference.assemble(image, factors, "dual")[1].shape == (5, 20, 18)
    assert inference.pad(image, 32).shape == (3, 32, 32)
    p = inference.class_probability({"logits": np.stack([np.zeros((2, 2)), np.ones((2, 2))])}, 1)
    assert np.allclose(p, np.e / (1 + np.e))
    with pytest.raises(ValueError):
        inference.class_probability([np.zeros((2, 2, 2))], 2)


def test_tile_stream(spark, tmp_path):
    from rasterloom.raster import Raster
    from rasterloom.streaming import tiles

    rows = [("r", 0, 0, i, 0, 4 * i, 2, 4, [0.9, 0.1, float("nan"), 0.6, 0.2, 0.5, 0.4, 0.7]) for i in range(3)]
    df = spark.createDataFrame(rows, tiles.TILE)
    df.write.parquet(str(tmp_path / "in"))
    tiles.ingest(tiles.tile_stream(spark, str(tmp_path / "in")), 0.5, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(got) == 3 and {(r.valid, r.foreground) for r in got} == {(7, 4)}
    r = Raster(tiles.pixels_of(df), 12, 2)
    assert r.pixels.count() == 24 and r.threshold(0.5).components().select("label").distinct().count() == 4
    assert r.region({"mode": "canvas_intersection", "bounds": [0, -2, 4, 0]}).pixels.count() == 8
