import glob
import random

from auditflow.operators.restore import merge_vaults, upsert_vault
from auditflow.sources.buckets import bucket_of, places, read_buckets, touched, update_buckets
from auditflow.streaming.guard import SESSION_DDL

ENTRIES = "scope string, token string, original string, start int, seq bigint"


def entries(spark, rows):
    return spark.createDataFrame(rows, ENTRIES)


def update(spark, path, rows, batch, buckets=8):
    update_buckets(upsert_vault(entries(spark, rows)), path, ["scope"], batch, merge_vaults, buckets)


def table(spark, path, before=None):
    return sorted((tuple(r) for r in read_buckets(spark, path, SESSION_DDL, before).collect()), key=str)


def test_batches_equal_one_upsert(spark, tmp_path):
    rnd, path, rows = random.Random(4), str(tmp_path / "t"), []
    for batch in range(3):
        new = [(rnd.choice(["hot", "hot", None, "", *"abcd"]), f"[T_{rnd.randint(1, 4)}]", f"v{batch}-{k}", rnd.randint(0, 3), batch * 100 + k) for k in range(30)]
        update(spark, path, new, batch)
        rows += new
    assert sorted(map(str, table(spark, path))) == sorted(str(tuple(r)) for r in upsert_vault(entries(spark, rows)).collect())


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    path = str(tmp_path / "t")
    update(spark, path, [(s, "[T_1]", "old", 0, 1) for s in "abcdefgh"], 0)
    hit = touched(entries(spark, [("a", "", "", 0, 0)]), ["scope"], 8)
    assert len(hit) == 1 and len(places(spark, path)) > 1
    update(spark, path, [("a", "[T_1]", "new", 0, 2)], 1)
    assert {b: at for b, at in places(spark, path).items()} == {b: int(b in hit) for b in places(spark, path, before=1)}
    assert {int(p.rsplit("=", 1)[1]) for p in glob.glob(f"{path}/data/version=1/bucket=*")} == hit
    now = {r[0]: r[2] for r in table(spark, path)}
    assert now == {s: "new" if s == "a" else "old" for s in "abcdefgh"}
    assert {r[2] for r in table(spark, path, before=1)} == {"old"}  # a reader of the version before


def test_a_replay_and_an_empty_batch_change_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    assert table(spark, path) == [] and places(spark, path) == {}
    update(spark, path, [], 0)
    assert table(spark, path) == []
    update(spark, path, [("a", "[T_1]", "one", 0, 1)], 1)
    update(spark, path, [("a", "[T_1]", "two", 0, 2), ("b", "[T_1]", "three", 5, 2)], 2)
    first = table(spark, path)
    update(spark, path, [("a", "[T_1]", "two", 0, 2), ("b", "[T_1]", "three", 5, 2)], 2)
    assert table(spark, path) == first == [("a", "[T_1]", "two", 2, 1, 0), ("b", "[T_1]", "three", 2, 2, 5)]


def test_a_batch_without_its_manifest_is_not_seen(spark, tmp_path):
    path = str(tmp_path / "t")
    update(spark, path, [("a", "[T_1]", "one", 0, 1)], 0)
    # A batch that was lost after its data and before its manifest.
    lost = upsert_vault(entries(spark, [("a", "[T_1]", "two", 0, 2)])).withColumn("bucket", bucket_of(["scope"], 8))
    lost.write.partitionBy("bucket").parquet(f"{path}/data/version=1")
    assert [r[2] for r in table(spark, path)] == ["one"]
    update(spark, path, [("a", "[T_1]", "two", 0, 2)], 1)
    assert [r[2] for r in table(spark, path)] == ["two"]
