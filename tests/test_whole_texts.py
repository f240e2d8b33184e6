"""Queries without SQL read whole tables and whole texts."""

from textloom.plans.registry import QUERIES


def test_cut_step_sees_long_documents(spark, tmp_path):
    words = [f"word{i:04}" for i in range(600)]
    rows = [(i, " ".join(w), len(" ".join(w))) for i, w in enumerate((words, words[50:450], ["other"] * 700))]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.id: r.cluster for r in QUERIES["N12_cut_step"](spark, str(tmp_path)).collect()}
    assert set(found) == {0, 1, 2} and found[0] == found[1] != found[2]


def test_leader_clusters_read_past_the_opening(spark, tmp_path):
    opening = " ".join(f"same{i:03}" for i in range(30))
    rows = [(0, opening + " " + " ".join(f"left{i}" for i in range(40))), (4, opening + " " + " ".join(f"right{i}" for i in range(40)))]
    spark.createDataFrame(rows, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {r.id: r.leader for r in QUERIES["C12_leader_clusters"](spark, str(tmp_path)).collect()} == {0: 0, 4: 4}
