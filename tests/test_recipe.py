from __future__ import annotations

import json

import pytest

from strataspark.sinks import recipe

BOX = {"origin": [0, 0, 0], "maximum": [1, 2, 3], "nsteps": [4, 4, 4]}


def write(tmp_path, model):
    path = tmp_path / "model.json"
    path.write_text(json.dumps({"schema": "any", "version": 1, "model": model}, indent=1))
    return str(path)


def test_inline_observations_and_unknown_faults(spark, tmp_path):
    frame = {"index": [0, 1], "columns": ["X", "feature_name", "val"], "data": [[1.5, "s0", float("nan")], [2, None, 4]]}
    model = {"bounding_box": BOX, "features": [{"name": "s0", "kind": "foliation", "faults": ["f", "gone"], "regions": []}, {"name": "f"}], "data_source": {"kind": "inline", "dataframe": frame}}
    got = recipe.load(spark, write(tmp_path, model))
    assert got.box == ([0, 0, 0], [1, 2, 3], [4, 4, 4])
    assert sorted(tuple(r) for r in got.features.select("name", "faults").collect()) == [("f", []), ("s0", ["f"])]
    assert [tuple(r) for r in got.data.orderBy("X").collect()] == [(1.5, "s0", None), (2.0, None, 4.0)]
    assert got.column.count() == 0


def test_csv_by_reference(spark, tmp_path):
    (tmp_path / "o.csv").write_text("X,feature_name\n1.5,a\n")
    got = recipe.load(spark, write(tmp_path, {"bounding_box": BOX, "features": None, "data_source": {"kind": "reference", "path": str(tmp_path / "o.csv")}}))
    assert [tuple(r) for r in got.data.collect()] == [(1.5, "a")]
    assert got.features.count() == 0


@pytest.mark.parametrize("model", [{"features": []}, {"bounding_box": BOX, "features": [{"kind": "x"}]}, {"bounding_box": BOX, "data_source": {"kind": "other"}}])
def test_broken_recipes_raise(spark, tmp_path, model):
    with pytest.raises(ValueError):
        recipe.load(spark, write(tmp_path, model))
