"""Feature collections cut into small ranges, against the whole file parsed at once."""

import json
import random

import pytest

from stratum.sources import collections


def feature(rng, i):
    words = ["", '"', "\\", '\\"', "{[", "}]", '"features": [{', "ж", " ", "x" * rng.randrange(60)]
    props = {"id": i, "t": "".join(rng.choice(words) for _ in range(rng.randrange(6))), "n": [{"a": [1, {"b": None}]}]}
    return {"type": "Feature", "properties": props, "geometry": {"type": "LineString", "coordinates": [[i, rng.random()], [1, 2]]} if i % 5 else None}


def whole(path):
    v = json.loads(path.read_text())
    return sorted((f["properties"]["id"], (f["geometry"] or {}).get("type"), json.dumps(f["properties"], sort_keys=True)) for f in v.get("features", []))


def told(rows):
    return sorted((json.loads(r.properties)["id"], r.geom_type, json.dumps(json.loads(r.properties), sort_keys=True)) for r in rows)


@pytest.mark.parametrize(("size", "n"), [(29, 4), (211, 40), (1 << 20, 40)])
def test_ranges(spark, tmp_path, size, n):
    rng = random.Random(size)
    features = [feature(rng, i) for i in range(n)]
    crs = {"type": "name", "properties": {"name": "a\\\"b", "features": [{"type": "Feature"}]}}
    a, b, c = (tmp_path / n for n in ("a b.geojson", "b.geojson", "c.json"))
    a.write_text(json.dumps({"crs": crs, "name": "isolines", "features": features, "tail": [{"x": {"y": 1}}]}, ensure_ascii=False, indent=1))
    b.write_text(json.dumps({"features": features[:3], "type": "FeatureCollection"}))
    c.write_text(json.dumps({"type": "FeatureCollection", "features": []}))
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "list.json").write_text('[{"features": [{"type": "Feature"}]}]')
    rows = collections.collection(spark, str(tmp_path), size=size).collect()
    assert {r.layer for r in rows} == {"isolines", "b"} and not any(r.corrupt for r in rows)
    assert told(r for r in rows if r.layer == "isolines") == whole(a)
    assert told(r for r in rows if r.layer == "b") == whole(b)
    assert all(a.read_bytes()[r.at : r.at + 1] == b"{" for r in rows if r.layer == "isolines")
    one = collections.collection(spark, str(tmp_path), layer="isolines", size=size)
    assert one.select("path").distinct().count() == 1 and one.count() == n


def test_cut_and_missing(spark, tmp_path):
    text = json.dumps({"features": [feature(random.Random(1), i) for i in range(6)]})
    (tmp_path / "cut.json").write_text(text[: text.rindex('"properties"') + 20])
    rows = collections.collection(spark, str(tmp_path), size=150).collect()
    assert sorted(json.loads(r.properties)["id"] for r in rows if r.corrupt is None) == list(range(5))
    assert [r.properties for r in rows if r.corrupt is not None] == [None]
    empty = tmp_path / "none"
    empty.mkdir()
    assert collections.collection(spark, str(empty)).count() == 0


def test_many_tasks_read_one_file(spark, tmp_path):
    with open(tmp_path / "big.geojson", "w") as f:
        f.write('{"type": "FeatureCollection", "features": [\n')
        f.write(",\n".join(json.dumps({"type": "Feature", "properties": {"id": i, "t": "y" * 900}, "geometry": {"type": "Point", "coordinates": [i, -i]}}) for i in range(20_000)))
        f.write("\n]}")
    out = collections.collection(spark, str(tmp_path), size=2 << 20)
    assert out.rdd.getNumPartitions() >= 9
    got = out.selectExpr("get_json_object(properties, '$.id')::bigint AS id", "coordinates").collect()
    assert sorted((r.id, r.coordinates) for r in got) == [(i, f"[{i},{-i}]") for i in range(20_000)]
