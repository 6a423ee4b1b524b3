"""Files that arrive in a folder are read once each."""

import json

from calorgrid.streaming import arrivals
from tests.test_geojson import CASES


def put(folder, name):
    (folder / f"{name}.geojsonl").write_text("\n".join(json.dumps(f) for f in CASES[name]))


def test_arrivals(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put(tmp_path / "in", "good")
    put(tmp_path / "in", "flows")
    run = lambda: arrivals.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), files_per_batch=1).awaitTermination()
    seen = lambda: {r["scene_id"]: r["count"] for r in spark.read.parquet(str(tmp_path / "out" / "objects")).groupBy("scene_id").count().collect()}
    run()
    assert seen() == {"good": 3, "flows": 5}
    put(tmp_path / "in", "split")
    run()
    run()
    assert seen() == {"good": 3, "flows": 5, "split": 2}
    query = arrivals.counts(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("arrived").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r["object_type"]: r["n"] for r in spark.table("arrived").groupBy("object_type").sum("n").toDF("object_type", "n").collect()}["oks_connection_point"] == 6
