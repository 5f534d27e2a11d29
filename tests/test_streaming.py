from cohesia.operators.graph import canonical_edges
from cohesia.streaming import edge_stream, keep_edges


def test_edges_arrive(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for k, text in enumerate(["1,2\n2,1\n3,3\n", "2,3\n1,2\n"]):
        (source / f"{k}.csv").write_text(text)
        q = keep_edges(edge_stream(spark, str(source)), f"{tmp_path}/table", f"{tmp_path}/checkpoint")
        q.awaitTermination()
    got = canonical_edges(spark.read.parquet(f"{tmp_path}/table")).collect()
    assert sorted((r.u, r.v) for r in got) == [(1, 2), (2, 3)]
