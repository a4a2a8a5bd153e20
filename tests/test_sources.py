from pyspark.sql import functions as F

from isobar.operators.features import sort_for_groups
from isobar.sources import candidates, sinks


def test_tables_and_small_rows_round_trip(spark, tmp_path):
    rows = candidates.rows_frame(spark, [{"q": "b", "n": 1}, {"q": "a", "n": None}], "q string, n int")
    sinks.write_table(rows, str(tmp_path / "t"), partition_by=["q"])
    sinks.write_table(rows, str(tmp_path / "t"), partition_by=["q"])  # replaces
    back = spark.read.parquet(str(tmp_path / "t"))
    assert {(r["q"], r["n"]) for r in back.collect()} == {("b", 1), ("a", None)}
    assert back.filter("q = 'b'").inputFiles()
    sinks.write_json_records(rows.select(F.to_json(F.struct("q", "n")).alias("audit_json")), str(tmp_path / "lines"))
    assert {r["value"] for r in spark.read.text(str(tmp_path / "lines")).collect()} == {'{"q":"b","n":1}', '{"q":"a"}'}


def test_first_mapping_entry_follows_the_order_of_files(spark, tmp_path):
    # The later file is larger, so it is packed into the first partition.
    folder = tmp_path / "mapping"
    folder.mkdir()
    (folder / "a.csv").write_text("tracklet_id,tc_id\nt1,first\nt1,second\n")
    (folder / "b.csv").write_text("tracklet_id,tc_id\n" + "".join(f"t1,late{i}\n" for i in range(500)) + "t2,only\n")
    rows = candidates.read_mapping(spark, str(folder))
    got = rows.groupBy("tracklet_id").agg(F.min_by("tc_id", "row_order").alias("tc")).collect()
    assert {r["tracklet_id"]: r["tc"] for r in got} == {"t1": "first", "t2": "only"}


def test_group_order_is_by_query_and_best_rank(spark):
    rows = spark.createDataFrame([(10, "b", 2), (9, "a", 5), (10, "a", 1), (9, "c", 5)], "query_id int, candidate_id string, source_min_rank int")
    assert [tuple(r) for r in sort_for_groups(rows).collect()] == [(10, "a", 1), (10, "b", 2), (9, "a", 5), (9, "c", 5)]
