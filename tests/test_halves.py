"""Halves survive standardizing and back."""

from strayfield.plans.registry import all_queries, all_sql


def test_halves_survive_standardizing_and_back(spark, tmp_path):
    import duckdb

    rows = [(n, [(n * 64 + i - 2000) / 128 for i in range(64)], 1) for n in range(64)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = {r[0]: list(r[1]) for r in con.execute(f"select vec_id, back from ({all_sql()['d10_standardize']})").fetchall()}
    got = {r["vec_id"]: list(r["back"]) for r in all_queries()["d10_standardize"](spark, str(tmp_path)).collect()}
    assert got == want
