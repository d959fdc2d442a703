import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.sources import files, synthetic
from quillon.streaming import episodes


def test_csv_contract(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("k,v\n1,2.5\n2,3\n")
    assert files.csv(spark, str(p), "k int, v double").agg(F.sum("v")).first()[0] == 5.5
    with pytest.raises(Exception):
        files.csv(spark, str(p), "v int, k double").collect()
    p.write_text("k,v\n1,abc\n")
    with pytest.raises(Exception):
        files.csv(spark, str(p), "k int, v double").collect()


def test_series_csv(spark, tmp_path):
    p = tmp_path / "s.csv"
    p.write_bytes("Date,Hour,Rented,T(°C)\n01/12/2017,0,254,-5.2\n01/12/2017,23,100,1\n".encode("latin-1"))
    r = files.series_csv(spark, str(p), "Date", "Hour", "Rented").collect()
    assert [str(x["timestamp"]) for x in r] == ["2017-12-01 00:00:00", "2017-12-01 23:00:00"] and r[0]["target"] == 254
    p.write_bytes(b"Date,Hour,Rented\n01/12/2017,24,254\n")
    with pytest.raises(Exception, match="bad hour"):
        files.series_csv(spark, str(p), "Date", "Hour", "Rented").collect()
    with pytest.raises(ValueError):
        files.series_csv(spark, str(p), "Date", "Hour", "Nothing")


def test_jsonl(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"a": 1}\n\n{"a": 2}\n')
    assert files.jsonl(spark, str(p), "a int", strict=False).count() == 2
    with pytest.raises(ValueError):
        files.jsonl(spark, str(p), "a int")


def test_mapping_and_matrix(spark, tmp_path):
    p = tmp_path / "m.json"
    p.write_text(json.dumps({"drug_z": "CC", "drug_a": "O"}))
    drugs = files.ordered_mapping(spark, str(p))
    assert [(r["pos"], r["id"]) for r in drugs.collect()] == [(0, "drug_z"), (1, "drug_a")]
    targets = spark.createDataFrame([(0, "target_b"), (1, "target_a")], "pos int, id string")
    cells = files.matrix(spark, [[1, np.nan], [10, 100]])
    long = files.interactions(cells, drugs, targets).orderBy("pair").collect()
    assert [(r["pair"], r["flat_index"], r["row_id"], r["col_id"]) for r in long] == [(0, 0, "drug_z", "target_b"), (1, 2, "drug_a", "target_b"), (2, 3, "drug_a", "target_a")]
    with pytest.raises(ValueError):
        files.matrix(spark, [[1, np.nan]], missing_ok=False)
    flat = dict(files.replication({"x": np.arange(12).reshape(2, 3, 2), "y": np.arange(4).reshape(2, 2)}, 1))
    assert list(flat["y"]) == [1, 3] and list(flat["x2"]) == [5, 11]


def test_corpus_and_gold(spark, tmp_path):
    c, g = tmp_path / "c.jsonl", tmp_path / "g.jsonl"
    c.write_text('{"doc_id": 1, "title": "T", "abstract": ["a.", "b."]}\n')
    assert files.corpus(spark, str(c)).first()["text"] == "T a. b."
    g.write_text('{"id": 1, "claim": "x", "evidence": {"7": [{"label": "SUPPORT", "sentences": [3, 1]}]}}\n{"id": 2, "claim": "y", "evidence": {}}\n')
    assert [tuple(r) for r in files.gold_citations(spark, str(g)).orderBy("claim_id").collect()] == [(1, 7, "SUPPORT", [1, 3]), (2, None, "NO_EVIDENCE", None)]
    runtime = files.only(files.jsonl(spark, str(g), "id long, claim string, evidence string"), ["id", "claim"])
    assert runtime.columns == ["id", "claim"]
    g.write_text('{"id": 1, "claim": "x", "evidence": {"7": [{"label": "SUPPORT", "sentences": [1]}], "8": [{"label": "CONTRADICT", "sentences": [1]}]}}\n')
    with pytest.raises(ValueError):
        files.gold_citations(spark, str(g))


def test_theorems_and_inventory(spark, tmp_path):
    (tmp_path / "t.lean").write_text("theorem a1 (x : Nat) :\n  x = x := by\n  rfl\n\ntheorem b2 : True := trivial\n")
    got = [tuple(r) for r in files.theorems(spark, str(tmp_path / "t.lean")).collect()]
    assert [(p, n) for p, n, _ in got] == [(0, "a1"), (1, "b2")] and got[1][2] == ": True"
    r = files.inventory(spark, str(tmp_path)).first()
    assert r["name"] == "t.lean" and len(r["sha256"]) == 64 and r["kind"] == "other"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, float("nan")), (1, 1.5)], "k int, v double")
    files.write_csv(df, str(tmp_path / "c"), ["k"])
    assert [r["k"] for r in spark.read.csv(str(tmp_path / "c"), header=True, inferSchema=True).collect()] == [1, 2]
    assert json.loads(files.report(df).first()[0]) == [{"k": 1, "v": 1.5}, {"k": 2, "v": None}]
    files.write_jsonl(df, str(tmp_path / "j"))
    files.append_journal(df, str(tmp_path / "n"))
    files.append_journal(df, str(tmp_path / "n"))
    assert spark.read.json(str(tmp_path / "n")).count() == 4 and spark.read.json(str(tmp_path / "j")).count() == 2
    assert files.markdown(df.orderBy("k"), "T").splitlines()[4:] == ["| 1 | 1.5 |", "| 2 | nan |"]
    with pytest.raises(ValueError):
        files.markdown(spark.range(5), "T", limit=3)


def test_generators_are_seeded(spark):
    a, b = (synthetic.flows(spark, 50, 10, seed=3).orderBy("flow_id").collect() for _ in range(2))
    assert a == b and len(a) == 90
    s = synthetic.structural(spark, "heterogeneous", 4000, 1)
    assert abs(s.agg(F.avg("ite")).first()[0] - 1) < 0.1
    assert abs(synthetic.structural(spark, "randomized", 4000, 1).agg(F.avg("t")).first()[0] - 0.5) < 0.05


EVENTS = [(1, "2024-01-01 00:00:00", 5, "view", 1.0), (2, "2024-01-01 00:30:00", 5, "view", 2.0), (3, "2024-01-01 03:00:00", 5, "purchase", 3.0), (4, "2024-01-02 00:00:00", 6, "view", 4.0)]


def stream(spark, tmp_path):
    df = spark.createDataFrame(EVENTS, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.to_timestamp_ntz("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    return df, spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))


def drained(query_frame, mode, tmp_path, name):
    q = query_frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp-{name}")).start()
    q.processAllAvailable()
    q.stop()
    return query_frame.sparkSession.table(name).collect()


def test_streamed_sessions_equal_the_table(spark, tmp_path):
    batch, s = stream(spark, tmp_path)
    rows = {(r["series"], r["n"], r["total"]) for r in episodes.sessions(batch).collect()}
    assert rows == {("view", 2, 3.0), ("purchase", 1, 3.0), ("view", 1, 4.0)}
    streamed = {(r["series"], r["n"], r["total"]) for r in drained(episodes.sessions(s), "append", tmp_path, "sessions_t")}
    assert streamed <= rows and ("view", 2, 3.0) in streamed
    assert len(drained(episodes.windowed(s), "update", tmp_path, "windows_t")) == 3


def test_streamed_state_and_journal(spark, tmp_path):
    batch, s = stream(spark, tmp_path)
    got = {r["user_id"]: (r["n"], r["last_action"], r["approved"]) for r in drained(episodes.review_state(s), "update", tmp_path, "state_t")}
    assert got == {5: (3, "purchase", True), 6: (1, "view", False)}
    q = episodes.journal(s, str(tmp_path / "j"), str(tmp_path / "cpj"))
    q.awaitTermination(60)
    assert spark.read.json(str(tmp_path / "j")).count() == 4
