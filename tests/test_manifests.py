import json

from veridex.operators.manifests import nested_manifest_explode


def test_order_deletion_and_odd_rows(spark):
    v = lambda n, status: {"version": n, "file": f"f{n}", "sourceType": "markdown", "status": status}
    manifest = {"b": {"documents": {"y": {"currentVersion": None, "versions": [v(2, "deleted"), v(1, "superseded")]}, "x": {"currentVersion": 1, "versions": [v(1, "active")]}}}, "a": {"documents": {"z": {"currentVersion": 3, "versions": [v(3, "active")]}, "w": {"currentVersion": None, "versions": []}}}}
    rows = [(1, json.dumps(manifest), "z"), (2, None, "z"), (3, "not json", "z"), (4, "{}", "z")]
    df = spark.createDataFrame(rows, "manifest_id long, manifest string, file string")
    got = [tuple(r) for r in nested_manifest_explode(df).orderBy("manifest_id", "place").collect()]
    assert got == [(1, 0, "a", "z", 3, "f3", "markdown", "active", False), (1, 1, "b", "x", 1, "f1", "markdown", "active", False), (1, 2, "b", "y", 1, "f1", "markdown", "superseded", True), (1, 3, "b", "y", 2, "f2", "markdown", "deleted", True)]
    assert nested_manifest_explode(df.limit(0)).count() == 0
