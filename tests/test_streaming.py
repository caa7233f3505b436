"""Refreshing the stored long table from arriving files."""

from rankloom.operators.evidence import UNIFIED
from rankloom.streaming.refresh import LONG_SCHEMA, arriving, refresh, running_statistics


def rows(spark, *values):
    data = [("ACH-1", g, None, "rna", v, "u", "depmap_rna", "1") for g, v in values]
    return spark.createDataFrame(data, LONG_SCHEMA).coalesce(1)


def test_each_file_is_taken_once(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    rows(spark, ("a", 1.0), (None, 2.0)).write.parquet(source)
    refresh(spark, source, out, checkpoint).awaitTermination()
    rows(spark, ("A", 3.0)).write.mode("append").parquet(source)
    for _ in range(2):
        refresh(spark, source, out, checkpoint).awaitTermination()
    stored = spark.read.parquet(out)
    assert sorted(r["value_raw"] for r in stored.collect()) == [1.0, 3.0] and set(stored.columns) == set(UNIFIED)


def test_running_statistics(spark, tmp_path):
    source = str(tmp_path / "in")
    rows(spark, ("a", 1.0), ("a", 3.0), ("b", 5.0)).write.parquet(source)
    query = running_statistics(arriving(spark, source)).writeStream.outputMode("complete").format("memory").queryName("running").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r["gene_symbol"]: (r["n"], r["mean"], r["sd"]) for r in spark.table("running").collect()}
    assert got == {"A": (2, 2.0, 1.0), "B": (1, 5.0, 0.0)}
