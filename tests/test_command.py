"""The command line over small files."""

import json

from calorgrid import __main__ as command
from tests.test_geojson import CASES


def test_commands(spark, tmp_path):
    for folder, features in (("maps", CASES["good"]), ("results", [])):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    places = [str(tmp_path / p) for p in ("maps", "results")]
    command.main(["audit", places[0], str(tmp_path / "audit")])
    (got,) = [json.loads(x) for f in (tmp_path / "audit").glob("*.json") for x in f.read_text().splitlines()]
    assert (got["demands"], got["parts"], got["coordinates"], got["total_flow"]) == (1, 3, 4, 10.0)
    command.main(["report", *places, str(tmp_path / "html")])
    assert "<svg" in next((tmp_path / "html" / "scene_id=a").glob("*.txt")).read_text()
