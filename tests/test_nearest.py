"""The nearest vectors by tiles are those of the SQL, with ties and missing vectors, and only k rows a query leave a tile."""

import random

import duckdb

from textloom.operators import retrieval as R
from textloom.plans.registry import ORACLES, QUERIES


def test_nearest_by_tiles(spark, tmp_path, monkeypatch):
    rng = random.Random(7)
    vectors = [[float(rng.randint(-3, 3)) + 0.5 for _ in range(4)] for _ in range(60)]
    rows = [(i, None if i in (100, 350) else rng.choice(vectors)) for i in range(420)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = {(r[0], r[1], r[2], r[3]) for r in con.sql(f"select q_id, vec_id, score, rank from ({ORACLES['R25_vector_topk']}) where q_id <> 100").fetchall()}
    for tile, part in ((1 << 14, 1 << 11), (64, 16)):
        monkeypatch.setattr(R, "TILE", tile)
        monkeypatch.setattr(R, "SLICE", part)
        got = QUERIES["R25_vector_topk"](spark, str(tmp_path)).filter("q_id <> 100").select("q_id", "vec_id", "score", "rank").collect()
        assert {tuple(r) for r in got} == want and len(got) == 40
    ids = R.pa.table({"vec_id": [3, 1, 2, 5], "v": [[1.0, 0.0], [1.0, 0.0], [0.0, 1.0], None]})
    out = R._nearest(2, 5)(ids, ids.slice(0, 1))
    assert out.to_pydict() == {"q_id": [3, 3], "vec_id": [1, 2], "score": [1.0, 0.0]}  # two of the tile's four rows
