import random

from cairnlake.operators.snapshot_changes import changes, nearest_ready
from tests.conftest import rows

FILES = "snapshot_id string, path string, blob_sha string, language string"


def snaps(spark, data):
    return spark.createDataFrame(data, "id string, parent_snapshot_id string, status string")


def test_nearest_ready_follows_chains(spark):
    s = snaps(spark, [("a", None, "ready"), ("b", "a", "failed"), ("c", "b", "building"), ("d", "c", "ready"), ("e", "gone", "ready"), ("f", "g", "failed"), ("g", "f", "failed"), ("h", "g", "ready"),
                      ("i", "i", "ready"), ("j", "d", "ready"), (None, "a", "ready"), ("k", None, "failed"), ("l", "k", "ready"), ("m1", "m2", "failed"), ("m2", "m3", "failed"), ("m3", "m1", "failed"), ("n", "m1", "ready")])
    assert rows(nearest_ready(s)) == [("d", "a"), ("j", "d")]


def test_long_chain(spark):
    chain = [("s0", None, "ready")] + [(f"s{i}", f"s{i - 1}", "failed") for i in range(1, 40)] + [("end", "s39", "ready")]
    assert rows(nearest_ready(snaps(spark, chain))) == [("end", "s0")]


def test_random_snapshots_against_sets(spark):
    rng = random.Random(3)
    tables = {f"s{i}": {f"p{j}": f"b{rng.randrange(4)}" for j in range(300) if rng.random() < 0.9} for i in range(4)}
    tables["s3"] = dict(tables["s2"]) | {"extra": "x"}
    data = [(s, p, b, None) for s, t in tables.items() for p, b in t.items()]
    files = spark.createDataFrame(data + data[:200], FILES)
    pairs = [("s1", "s0"), ("s2", "s1"), ("s3", "s2"), ("s2", "s0")]
    got = rows(changes(files, spark.createDataFrame(pairs, "later string, earlier string"), mean_rows=8).select("later", "earlier", "key", "change"))
    want = []
    for later, earlier in pairs:
        a, b = tables[earlier], tables[later]
        want += [(later, earlier, p, "added" if p not in a else "removed" if p not in b else "changed") for p in a.keys() | b.keys() if a.get(p) != b.get(p)]
    assert got == sorted(want, key=str)


def test_edges(spark):
    files = spark.createDataFrame([("a", "p", "1", "x"), ("a", "q", None, "x"), ("b", "q", "2", "x"), ("b", None, "3", "x"), (None, "p", "1", "x"), ("b", "", "4", "x"), ("b", "q", "1", "x")], FILES)
    pairs = spark.createDataFrame([("b", "a"), ("a", "empty"), ("empty", "b"), ("b", "a")], "later string, earlier string")
    got = rows(changes(files.withColumnRenamed("language", "chunk"), pairs).select("later", "key", "change", "old", "new"))
    assert got == sorted([("b", "p", "removed", "1", None), ("b", "q", "changed", None, "2"), ("b", "", "added", None, "4"), ("a", "p", "added", None, "1"), ("a", "q", "added", None, None),
                          ("empty", "q", "removed", "2", None), ("empty", "", "removed", "4", None)], key=str)


def test_empty(spark):
    assert changes(spark.createDataFrame([], FILES), spark.createDataFrame([], "later string, earlier string")).count() == 0
    assert nearest_ready(snaps(spark, [])).count() == 0
