from datetime import datetime, timedelta

from threadmill.sources import caches


def test_one_bad_row_voids_a_ledger(spark, tmp_path):
    good = "1,2,a,b,1,1,0,0,10,2,part1\n3,3,b,c,0,1,0,0,5,1,part2\n"
    for name, text in (("ok", good), ("short", good + "4,5,a\n"), ("word", good + "x,5,a,b,1,1,0,0,1,1,p\n"), ("back", good + "9,8,a,b,1,1,0,0,1,1,p\n")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "ledger.csv").write_text(text)
    got = caches.read_ledger(spark, str(tmp_path)).collect()
    assert [(r.session_id, r.from_id, r.to_id) for r in sorted(got)] == [("ok", 1, 2), ("ok", 3, 3)]


def test_freshness(spark):
    now = datetime(2026, 1, 1)
    cached = spark.createDataFrame([("a", now), ("b", now)], "session_id string, written_at timestamp")
    seen = spark.createDataFrame([("a", now + timedelta(seconds=10), "file"), ("b", now + timedelta(seconds=20), "file"), ("c", now, "file"), ("d", now, "database")], "session_id string, mtime timestamp, backend_kind string")
    assert [r.session_id for r in caches.fresh(cached, seen).collect()] == ["a"]
