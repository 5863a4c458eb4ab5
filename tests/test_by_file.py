"""Features by file: what is computed again after an append, a change, a removal and a lost job."""
import os
import shutil
import time

from pyspark.sql import functions as F

from measurekit.sources import tables


def test_only_changed_files_are_computed(spark, tmp_path):
    src, folder, seen = tmp_path / "src with space", str(tmp_path / "store"), []
    src.mkdir()

    def put(name, lo, hi):
        spark.range(lo, hi).select("id", (F.col("id") * 2).alias("v")).coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "one"))
        part = next(p for p in os.listdir(tmp_path / "one") if p.startswith("part"))
        shutil.copy(tmp_path / "one" / part, src / f"{name}.parquet")

    def features(rows):
        seen.append(rows.count())
        return rows.select("id", (F.col("v") + 1).alias("w"), "file_key")

    def ids(params="p"):
        return sorted(r["id"] for r in tables.materialize_files(spark, str(src), folder, features, params).collect())

    put("a", 0, 10)
    put("b+c", 10, 30)
    assert ids() == list(range(30)) and seen == [30]
    assert ids() == list(range(30)) and seen == [30]            # nothing changed, nothing computed
    put("d", 30, 35)
    assert ids() == list(range(35)) and seen == [30, 5]         # an append
    time.sleep(.01)
    put("a", 100, 103)
    assert ids() == [*range(10, 35), 100, 101, 102] and seen == [30, 5, 3]
    os.remove(src / "d.parquet")
    assert ids() == [*range(10, 30), 100, 101, 102] and seen == [30, 5, 3]
    os.makedirs(f"{folder}/batch-lost/rows")                    # a job that ended before its manifest
    assert ids() == [*range(10, 30), 100, 101, 102] and seen == [30, 5, 3]
    assert len(ids("other parameters")) == 23 and seen[-1] == 23


def test_many_changed_files_are_joined(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "MANY_FILES", 2)
    spark.range(50).repartition(5).write.parquet(str(tmp_path / "src"))
    out = tables.materialize_files(spark, str(tmp_path / "src"), str(tmp_path / "store"), lambda d: d.select("id", "file_key"))
    assert out.count() == 50
