import json

from orrery.__main__ import main
from orrery.streaming.observations import current_version


def test_parse_and_list(capsys):
    assert main(["parse", "floods in 2023", "--now", "2026-01-01T00:00:00Z"]) == 0
    assert json.loads(capsys.readouterr().out)["intent"] == "find-events"
    assert main(["queries"]) == 0 and "events_near_point" in capsys.readouterr().out


def test_refresh_twice(spark, tmp_path, capsys):
    quakes = {"features": [{"id": f"q{i}", "geometry": {"coordinates": [75.0 + 10 * i, 15.0, 1.0]}, "properties": {"mag": 5.0, "place": "p", "time": 1767225600000, "status": "reviewed"}} for i in range(2)]}
    (tmp_path / "q.json").write_text(json.dumps(quakes))
    (tmp_path / "a.json").write_text(json.dumps({"type": "MultiPolygon", "coordinates": [[[[70, 10], [80, 10], [80, 20], [70, 20]]]]}))
    store = str(tmp_path / "store")
    for n in range(2):
        assert main(["refresh", "earthquakes", str(tmp_path / "q.json"), store, "--area", str(tmp_path / "a.json")]) == 0
        assert {r["disposition"]: r["n"] for r in json.loads(capsys.readouterr().out)} == {"kept": 1, "outside": 1}
        number, path = current_version(spark, store)
        assert number == n and [r.id for r in spark.read.parquet(path).collect()] == ["earthquakes:q0"]
