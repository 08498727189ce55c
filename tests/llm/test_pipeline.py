import duckdb

import __spark_entry__
import corpus_pipeline
from threadmill.llm import queries


def test_all_are_registered():
    names = list(__spark_entry__.queries())
    assert [n.split("_")[0] for n in names if n in queries.QUERIES] == [*(f"op{i}" for i in range(1, 11)), "pipeline"]


def test_near_dedup_query_matches_sql(spark, sf_dir):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = sorted(c.execute(queries.ORACLES["op8_near_dedup"]).fetchall())
    got = queries.QUERIES["op8_near_dedup"](spark, sf_dir).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got)) == want and any(not r.kept for r in got)


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen, kept = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen = corpus_pipeline.cut(stage(spark, seen, sf_dir))
        assert seen.columns == docs.columns, name
        kept.append(seen.count())
    assert kept[0] > kept[1] == kept[2] >= kept[3] >= kept[4] > 0
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() == kept[4] and set(out.columns) >= {"doc_id", "size", "source_size", "target", "taken"}
    nulls = docs.limit(3).selectExpr("cast(null as bigint) doc_id", "cast(null as string) text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, nulls, sf_dir).count() == 3, name
