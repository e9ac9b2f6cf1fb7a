"""The transcript store's layout: what an append writes, and what a lookup reads."""

import glob
import hashlib
import os

from parley.sources import store


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def files_of(path):
    return {f: os.path.getmtime(f) for f in glob.glob(path.removeprefix("file://") + "/bucket=*/batch=*/*.parquet")}


def results(spark, names, tag):
    return spark.createDataFrame([(sha(n), "plain", False, f"{tag}-{n}") for n in names], store.STORED)


def test_appends_add_what_is_new_and_touch_nothing_else(spark):
    path = store.shared_path(spark, "store-test")
    store.append_batch(results(spark, ["a", "b", "c"], "one"), path, "1")
    first = files_of(path)
    store.append_batch(results(spark, ["b", "c", "d", "d"], "two"), path, "2")
    assert {f: t for f, t in files_of(path).items() if f in first} == first
    rows = sorted((r.hash, r.transcript, r.batch) for r in store.open_store(spark, path).collect())
    assert rows == sorted([(sha("a"), "one-a", "1"), (sha("b"), "one-b", "1"), (sha("c"), "one-c", "1"), (sha("d"), "two-d", "2")])
    for batch, names, tag in (("2", ["b", "c", "d"], "two"), ("1", ["a", "b", "c"], "one")):
        store.append_batch(results(spark, names, tag), path, batch)
        assert sorted((r.hash, r.transcript, r.batch) for r in store.open_store(spark, path).collect()) == rows


def test_what_isnt_a_hash_never_gets_in(spark):
    path = store.shared_path(spark, "store-test")
    rows = spark.createDataFrame([("zz", "plain", False, "x"), (None, "plain", False, "y"), (sha("a").upper(), "plain", False, "z")], store.STORED)
    store.append_batch(rows, path, "1")
    assert store.open_store(spark, path).isEmpty()


def test_a_lookup_reads_its_buckets_alone(spark):
    path = store.shared_path(spark, "store-test")
    names = [f"n{i}" for i in range(300)]
    store.append_batch(results(spark, names, "t"), path, "1")
    asked = spark.createDataFrame([(1, sha("n5")), (2, sha("n77")), (3, "no hash"), (4, sha("other"))], "file_id long, hash string")
    found = store.lookup(asked, path, "plain", "plain")
    assert {r.file_id: r.transcript for r in found.collect()} == {1: "t-n5", 2: "t-n77", 3: None, 4: None}
    wanted = {sha(n)[:2] for n in ("n5", "n77", "other")}
    read = store.open_store(spark, path, store.buckets_of(asked))
    assert {f.split("bucket=")[1][:2] for f in read.inputFiles()} >= {sha("n5")[:2]}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan
    assert sorted(store.buckets_of(asked)) == sorted(wanted)
    scanned = read.select("bucket").distinct().collect()
    assert {r.bucket for r in scanned} <= wanted
