"""Logs in bundles: the same lines, numbers and texts as in a file each, in files whose number goes with the bytes."""

import glob

from pyspark.sql import functions as F

from threadmill.plans import stores
from threadmill.sources import jsonl


def test_lines_of_bundles_keep_their_numbers(spark, tmp_path):
    """Logs share bundles, bundles are split inside of logs, and damaged and blank lines count."""
    logs = {f"/a b/{k}\t%.jsonl": [None if i % 7 == 3 else "{broken" if i % 5 == 1 else f'{{"n":{i},"é":"\\t日"}}' for i in range(n)] for k, n in enumerate((3000, 1, 40, 900, 5))}
    rows = [(p, i, x) for p, lines in logs.items() for i, x in enumerate(lines)]
    jsonl.write_bundles(spark.createDataFrame(rows, "path string, at long, raw string").repartition(7), str(tmp_path / "b"), "at")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = jsonl.bundled_lines(spark, str(tmp_path / "b")).select("path", "line", "raw", F.col("rec").isNull().alias("bad")).collect()
        texts = {r["path"]: r["text"] for r in jsonl.bundled_files(spark, str(tmp_path / "b")).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(map(tuple, got)) == sorted((p, i + 1, x, x == "{broken") for p, i, x in rows if x is not None)
    assert texts == {p: "\n".join(x or "" for x in lines) for p, lines in logs.items()}


def test_stores_do_not_write_a_file_per_session(spark, sf_dir, tmp_path, monkeypatch):
    """A file costs the file system and the driver the same however short it is, so their number must not go with the sessions."""
    monkeypatch.setattr(stores, "shared_folder", lambda spark, name: str(tmp_path / name))
    assert stores.store_journal(spark, sf_dir).select("session_id").distinct().count() >= 10
    assert len(glob.glob(f"{tmp_path}/store/**/*.txt", recursive=True)) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
