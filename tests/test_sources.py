import pytest

from docgrove.sources.tables import delete_rows, merge_parts, read, upsert_rows, write
from docgrove.streaming.upserts import DocumentTable


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "docid long, t string")
    for kind in ("parquet", "orc", "json"):
        write(df, f"{tmp_path}/{kind}", kind)
        got = read(spark, f"{tmp_path}/{kind}", kind, "docid long, t string")
        assert sorted(map(tuple, got.collect())) == [(1, "a"), (2, None)]
    with pytest.raises(ValueError):
        read(spark, "x", "xml")


def test_upserts_and_deletes(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "docid long, t string")
    new = spark.createDataFrame([("c", 2), ("d", 3)], "t string, docid long")
    assert sorted(map(tuple, upsert_rows(df, new, "docid").collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert [tuple(r) for r in delete_rows(df, new, "docid").collect()] == [(1, "a")]
    turns = spark.createDataFrame([(1, 2, "y"), (1, 1, "x")], "docid long, turn int, t string")
    assert merge_parts(turns, "docid", "t", "turn").first()["t"] == ["x", "y"]


def test_stream_keeps_the_newest(spark, tmp_path):
    source = f"{tmp_path}/in"
    table = DocumentTable(spark, f"file://{tmp_path}/table", "docid")
    schema = "docid long, t string, at int"
    for k, rows in enumerate([[(1, "a", 1), (2, "b", 1), (1, "a2", 2)], [(2, "b2", 3), (3, "c", 3)]]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        table.follow(spark.readStream.schema(schema).parquet(source), "at", f"{tmp_path}/cp").awaitTermination()
    assert sorted((r["docid"], r["t"]) for r in table.current().collect()) == [(1, "a2"), (2, "b2"), (3, "c")]


def test_a_merge_writes_only_touched_buckets(spark, tmp_path):
    table = DocumentTable(spark, f"file://{tmp_path}/table", "docid", buckets=8)
    table.merge(spark.range(100).selectExpr("id AS docid", "'a' AS t", "1 AS at"), 1, "at")
    for version in (2, 3, 4):
        table.merge(spark.createDataFrame([(5, f"v{version}", version)], "docid long, t string, at int"), version, "at")
        places = table._manifest()["buckets"]
        assert sum(p == f"d{version}" for p in places.values()) == 1 and len(places) == 8
    got = {r["docid"]: r["t"] for r in table.current().collect()}
    assert len(got) == 100 and got.pop(5) == "v4" and set(got.values()) == {"a"}
    assert {r["t"] for r in table.current(before=4).where("docid = 5").collect()} == {"v3"}
    table.merge(spark.createDataFrame([(5, "late", 3), (6, "new", 2)], "docid long, t string, at int"), 5, "at")
    assert sorted((r["docid"], r["t"]) for r in table.current().where("docid IN (5, 6)").collect()) == [(5, "v4"), (6, "new")]
    assert not (tmp_path / "table" / "d2").exists()  # no version that is kept needs it
