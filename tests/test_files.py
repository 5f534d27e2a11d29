import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohesia import storage
from cohesia.index import Index
from cohesia.operators import analysis, graph, hierarchy, search
from cohesia.sources import binary, readers, writers
from tests.graphs import clique_chain


@pytest.fixture
def put(tmp_path):
    def write(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    return write


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_edge_files(spark, put, tmp_path):
    want = [(1, 2), (3, 5_000_000_000)]
    assert rows(readers.delimited_edges(spark, put("a.csv", "1,2\n3,5000000000\n"))) == want
    assert rows(readers.delimited_edges(spark, put("b.tsv", "x\ty\n1\t2\n3\t5000000000\n"), "\t", True)) == want
    assert rows(readers.whitespace_edges(spark, put("c.txt", "1   2\n3\t5000000000\n\nbad line\n"))) == want
    df = spark.createDataFrame(want, "u long, v long")
    writers.edges_csv(df, f"{tmp_path}/out", ";", True)
    assert rows(readers.delimited_edges(spark, f"{tmp_path}/out", ";", True)) == want


def test_query_files(spark, put, tmp_path):
    q = readers.query_file(spark, put("q.txt", "1507\n2024,33\n\n4 48\n3 5, 6\n"))
    assert [tuple(r) for r in q.orderBy("query_id").collect()] == [(0, None, [1507]), (1, None, [2024, 33]), (3, 4, [48]), (4, 3, [5, 6])]
    v = readers.query_file(spark, put("v.txt", "17 10\n5\n"), "vertex_first")
    assert [tuple(r) for r in v.orderBy("query_id").collect()] == [(0, 10, [17]), (1, None, [5])]
    with pytest.raises(ValueError):
        readers.query_file(spark, put("w.txt", "1\n"), "other")
    ids = spark.createDataFrame([(0, 33), (1, 48)], "id long, orig long")
    got = {r.query_id: (r.q, r.found) for r in readers.translate_queries(q, ids).collect()}
    assert got[1] == ([-1, 0], False) and got[3] == ([1], True)
    writers.queries_text(v, f"{tmp_path}/qs", "vertex_first")
    assert [r.value for r in spark.read.text(f"{tmp_path}/qs").collect()] == ["17 10", "5"]


def test_positional_files_and_logs(spark, put):
    assert rows(readers.positional(spark, put("core.txt", "3\n2\n5\n"), "core")) == [(0, 3), (1, 2), (2, 5)]
    assert rows(readers.core_index(spark, put("i.tsv", "node\tcore\n4\t2\n"))) == [(4, 2)]
    assert rows(readers.search_log(spark, put("log", "start\n1,20,300\nnoise\n4,5,6\n"))) == [(1, 20, 300), (4, 5, 6)]
    assert rows(readers.names(spark, put("n", "alpha\n\n beta \n"))) == [("alpha",), ("beta",)]
    put("t1", "x\nElapsed (wall clock) time (h:mm:ss or m:ss): 1:02.50\n")
    put("t2", "Elapsed (wall clock) time: 1:00\nElapsed (wall clock) time: 2:00\n")
    folder = put("t3", "nothing\n").rsplit("/", 1)[0]
    got = {r.file.rsplit("/", 1)[1]: r.time for r in readers.wall_clock_files(spark, folder + "/t*").collect()}
    assert got == {"t1": 62.5, "t2": None, "t3": None}


def test_results_and_index(spark, tmp_path, put):
    x = Index(graph.canonical_edges(spark.createDataFrame(clique_chain([3, 4, 3]), "u long, v long")))
    writers.save_index(x.tables(), f"{tmp_path}/index")
    back = readers.load_index(spark, f"{tmp_path}/index")
    for name, table in x.tables().items():
        assert rows(back[name]) == rows(table)
    batch = spark.createDataFrame([(0, 0, [0]), (1, 0, [4])], "query_id long, kmin int, q array<long>")
    found = search.answer_vertices(search.multi_search(batch, x.comp, x.core), x.comp)
    writers.communities_text(found, f"{tmp_path}/result")
    got = readers.community_files(spark, f"{tmp_path}/result/query_id=1/k=3")
    assert sorted(r.id for r in got.collect()) == [3, 4, 5, 6]
    assert sorted(r.id for r in readers.community_files(spark, put("e.txt", "1 2\n2 3\n-1\n"), edges=True).collect()) == [1, 2, 3]
    writers.report_csv(hierarchy.core_profile(x.nodes), f"{tmp_path}/profile")
    assert spark.read.csv(f"{tmp_path}/profile", header=True).columns == ["core", "ncomm", "nvert"]
    writers.core_tsv(x.core, f"{tmp_path}/core")
    assert rows(readers.core_index(spark, f"{tmp_path}/core")) == rows(x.core)
    writers.vertices_csv(graph.dense_ids(graph.vertex_set(x.edges)), f"{tmp_path}/map")
    assert spark.read.csv(f"{tmp_path}/map", header=True).columns == ["orig", "new"]
    writers.positional_text(x.core, "core", f"{tmp_path}/pos")
    assert len(spark.read.text(f"{tmp_path}/pos").collect()) == 10


def test_folders_of_many_files_and_splits(spark, tmp_path):
    n = 5000
    frame = spark.createDataFrame([(i, i * 7 % 1000) for i in range(n)], "id long, core long").repartition(7)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        writers.positional_text(frame, "core", f"{tmp_path}/pos")
        assert len([f for f in os.listdir(f"{tmp_path}/pos") if f.startswith("part-")]) > 1
        assert rows(readers.positional(spark, f"{tmp_path}/pos", "core")) == rows(frame)
        queries = frame.select(F.col("id").alias("query_id"), F.lit(1).alias("kmin"), F.array("id", "core").alias("q"))
        writers.queries_text(queries, f"{tmp_path}/qs")
        assert rows(readers.query_file(spark, f"{tmp_path}/qs")) == rows(queries)
        (tmp_path / "one.txt").write_bytes(b"".join(b"%d\r\n" % i if i % 3 else b"\n" for i in range(n)))
        got = readers.positional(spark, f"{tmp_path}/one.txt", "x")
        assert rows(got) == rows(spark.createDataFrame([(i, i) for i in range(n) if i % 3], "id long, x long"))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_binary_adjacency(spark, tmp_path, monkeypatch):
    rnd = random.Random(3)
    edges = {(min(a, b), max(a, b)) for a, b in ((rnd.randrange(300), rnd.randrange(300)) for _ in range(900)) if a != b and a % 7 and b % 7}
    near = {v: sorted({b for a, b in edges if a == v} | {a for a, b in edges if b == v}) for v in range(300)}
    starts = [300 + sum(len(near[w]) for w in range(v)) for v in range(300)]
    want = np.array([*starts, *[w for v in range(300) for w in near[v]]], dtype="<u8").tobytes()
    adj = graph.symmetric(spark.createDataFrame(sorted(edges), "u long, v long"))
    for size in (binary.RANGE, 16):
        monkeypatch.setattr(binary, "RANGE", size)
        monkeypatch.setattr(binary, "BIN_ROWS", 10 * size)
        binary.write_adjacency(adj, 300, f"{tmp_path}/g{size}")
        assert (tmp_path / f"g{size}").read_bytes() == want
        assert rows(binary.adjacency_file(spark, f"{tmp_path}/g{size}")) == rows(adj)
    binary.write_adjacency(adj.limit(0), 0, f"{tmp_path}/none")
    assert (tmp_path / "none").read_bytes() == b"" and binary.adjacency_file(spark, f"{tmp_path}/none").count() == 0
    (tmp_path / "bad").write_bytes(np.array([9, 9], dtype="<u8").tobytes())
    with pytest.raises(ValueError):
        binary.adjacency_file(spark, f"{tmp_path}/bad")


def test_intermediate_folders(spark, tmp_path):
    table = storage.cut(spark.range(5), "five")
    assert spark.sparkContext.applicationId in table._cohesia_path
    storage.drop(table)
    storage.drop(spark.range(1))
    with pytest.raises(ValueError):
        storage.remove(spark, f"{tmp_path}/elsewhere")

    class Cluster:
        applicationId, master = "other", "spark://far"
        getConf = staticmethod(dict)
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Cluster

    with pytest.raises(RuntimeError):
        storage.shared_root(Session)


def test_timing(spark):
    t = spark.createDataFrame([("n", "index", "a", 1.0), ("n", "index", "b", 2.0), ("m", "index", "a", 3.0)], "network string, op string, impl string, time double")
    many = spark.range(1001).select(F.lit("n").alias("network"), F.lit("o").alias("op"), F.col("id").cast("string").alias("impl"), F.lit(1.0).alias("time"))
    with pytest.raises(ValueError):
        analysis.timing_table(many)
    assert rows(analysis.timing_table(t)) == [("m", "index", 3.0, None), ("n", "index", 1.0, 2.0)]
