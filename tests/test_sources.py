"""Scenario files, and percentiles from stored sketches."""

import json
import random
import shutil

import pytest

from ledgerlens.operators import traces as T
from ledgerlens.plans import store_queries
from ledgerlens.sources import stores

YAML = """id: SC-1
initial_state: {customer_id: 7, authenticated: true}
conversation:
  - user: "I lost my card"
expected:
  tools: [freeze_card]
  prohibited_tools: []
  unknown: 1
---
id: [not, a, text]
---
a: [unclosed
---

---
id: SC-2
"""


def test_scenario_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.yaml").write_text(YAML)
    (tmp_path / "sub" / "b.json").write_text(json.dumps({"id": "SC-3", "expected": {"must_not": ["x"]}}) + "\n\n{broken\n[1]\n")
    (tmp_path / "readme.txt").write_text("no scenario")
    (tmp_path / "_SUCCESS").write_text("")
    df = stores.read_scenarios(spark, str(tmp_path))
    assert df.rdd.getNumPartitions() == 2  # one a file
    got = {(r.path.rpartition("/")[2], r.number): r for r in df.collect()}
    assert {k: (r.id, r.error) for k, r in got.items()} == {
        ("a.yaml", 0): ("SC-1", None), ("a.yaml", 1): (None, "id: not a text"), ("a.yaml", 2): (None, "yaml: expected ',' or ']', but got '<stream end>'"), ("a.yaml", 3): ("SC-2", None),
        ("b.json", 0): ("SC-3", None), ("b.json", 1): (None, "json: Expecting property name enclosed in double quotes"), ("b.json", 2): (None, "document: not a mapping"),
    }
    one = got["a.yaml", 0]
    assert (one.initial_state.customer_id, one.initial_state.authenticated, one.conversation[0].user, one.expected.tools, one.expected.must_not) == ("7", True, "I lost my card", ["freeze_card"], None)
    assert got["b.json", 0].expected.must_not == ["x"] and got["a.yaml", 3].initial_state is None


def test_scenario_files_are_bounded_and_read_once(spark, data, tmp_path, monkeypatch):
    """Written scenarios are dealt to files, so to tasks, of a bounded number of documents; io4 makes each
    document's row once, however often its answer is asked for."""
    stores.write_scenarios(spark.range(0, 95, 1, 2).selectExpr("concat('---\\nid: SC-', id) AS value"), str(tmp_path / "yaml"), 10)
    df = stores.read_scenarios(spark, str(tmp_path / "yaml"), "yaml")
    assert df.rdd.getNumPartitions() == 10 and df.groupBy("path").count().agg({"count": "max"}).first()[0] == 10
    assert sorted(int(r.id[3:]) for r in df.collect()) == list(range(95))
    folders = []
    monkeypatch.setattr(store_queries, "new_folder", lambda spark, name: folders.append(f"{tmp_path}/{name}") or folders[-1])
    out = store_queries.io4(spark, data)
    assert "BatchScan" not in out._jdf.queryExecution().executedPlan().toString()
    shutil.rmtree(f"{tmp_path}/scenarios")
    assert out.count() == out.select("id").distinct().count() > 0


def test_scenario_file_and_empty_folder(spark, tmp_path):
    (tmp_path / "x.txt").write_text("id: A\n---\nid: B\n")
    assert [r.id for r in stores.read_scenarios(spark, str(tmp_path / "x.txt"), "yaml").orderBy("number").collect()] == ["A", "B"]
    (tmp_path / "none").mkdir()
    assert stores.read_scenarios(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="format is yaml or json"):
        stores.read_scenarios(spark, str(tmp_path), "xml").collect()


def test_merged_sketches_are_near_exact_percentiles(spark):
    r = random.Random(3)
    rows = [(k, f"2024-01-0{1 + i % 5} {i % 24:02d}:00:00", r.lognormvariate(0, 1.5) if k == "a" else float(i % 3)) for k in "ab" for i in range(20_000)] + [("a", "2024-01-01 00:00:00", None), ("c", "2024-01-01 00:00:00", 4.0)]
    df = spark.createDataFrame(rows, "event string, at string, x double").withColumn("ts", T.F.col("at").cast("timestamp_ntz")).repartition(6)
    stored = T.sketches(df, ["event"], "x", "ts")
    assert stored.agg(T.F.max(T.F.length("sketch"))).first()[0] < 40_000
    got = {x.event: x for x in T.merged_percentiles(stored, ["event"]).collect()}
    assert {k: (x.n, x.hours) for k, x in got.items()} == {"a": (20_000, 120), "b": (20_000, 120), "c": (1, 1)}
    values = sorted(v for k, _, v in rows if k == "a" and v is not None)
    for p, name in ((0.5, "p50"), (0.9, "p90"), (0.95, "p95")):
        assert abs(sum(v <= got["a"][name] for v in values) / len(values) - p) <= 2 * T.SKETCH_RANK_ERROR
    assert (got["c"].p50, got["b"].p95) == (4.0, 2.0)
