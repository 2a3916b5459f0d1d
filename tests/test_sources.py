"""Broken input rows and repeated log writes."""

from pyspark.sql import functions as F

from tessera.sources import files as FS

LINES = ["seq_id,chain_a,chain_b,tags", '1,"casf","gha","Q"', '2,"cas","","X"', "3,cas,,X", "4,,abc,Q", "x5,cas,abc,Q", "6,cas", '7,"a","b","Q",extra',
         '8,"pq","rs",', ""]


def test_rejects_are_routed_and_counted_in_the_same_pass(spark, tmp_path):
    (tmp_path / "in.csv").write_text("\n".join(LINES))
    good, rejects, seen = FS.read_checked(spark, str(tmp_path / "in.csv"))
    rows = sorted((r.seq_id, r.chain_a, r.chain_b, r.tags) for r in good.collect())
    assert rows == [(1, "casf", "gha", "Q"), (2, "cas", "", "X"), (8, "pq", "rs", None)]
    assert seen.get == {"rows": 8, "corrupt": 3, "null_chain": 2}
    got = sorted((r.reason, r.raw) for r in rejects.collect())
    assert [g for g in got if g[0] == "corrupt"] == [("corrupt", "6,cas"), ("corrupt", '7,"a","b","Q",extra'), ("corrupt", "x5,cas,abc,Q")]
    assert [g[1][:10] for g in got if g[0] == "null chain"] == ['{"seq_id":', '{"seq_id":'] and len(got) == 5


def test_rejects_of_other_formats_and_empty_input(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "b", "Q"), (None, "a", "b", "Q"), (2, None, "b", "Q"), (3, "", "", None)],
                               "seq_id long, chain_a string, chain_b string, tags string")
    df.write.parquet(str(tmp_path / "p"))
    good, rejects, seen = FS.read_checked(spark, str(tmp_path / "p"), fmt="parquet")
    assert sorted(r.seq_id for r in good.collect()) == [1, 3] and seen.get == {"rows": 4, "corrupt": 1, "null_chain": 1}
    assert rejects.count() == 2
    df.limit(0).write.parquet(str(tmp_path / "e"))
    assert FS.read_sequences(spark, str(tmp_path / "e"), fmt="parquet").count() == 0


def test_empty_chains_survive_a_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "", "Q"), (2, "", "", None), (3, None, "x", "Q")], "seq_id long, chain_a string, chain_b string, tags string")
    FS.write_table(df, str(tmp_path / "c"), fmt="csv")
    assert sorted(tuple(r) for r in FS.read_sequences(spark, str(tmp_path / "c")).collect()) == [(1, "a", "", "Q"), (2, "", "", None)]


def test_an_epoch_written_twice_is_in_the_log_once(spark, tmp_path):
    path = str(tmp_path / "log")
    step = lambda e, v: spark.createDataFrame([("train", "Loss", e, v), ("test", "Loss", e, v + 1)], "split string, tag string, step long, value double")
    for run in ("one", "two"):
        for e in range(3):
            FS.append_metrics(step(e, float(e)), path, run)
    FS.append_metrics(step(1, 7.0), path, "one")
    FS.append_metrics(step(1, 7.0), path, "one")
    log = FS.read_metrics(spark, path)
    assert log.count() == 12
    assert sorted(r.value for r in FS.read_metrics(spark, path, "one").where("step = 1").collect()) == [7.0, 8.0]
    assert sorted(r.value for r in FS.read_metrics(spark, path, "two").where("step = 1").collect()) == [1.0, 2.0]
    assert log.where(F.col("run") == "one").groupBy("step").count().count() == 3


def test_tasks_put_run_logs_in_place(spark, tmp_path):
    from tessera.sources import files as FS
    rows = [(r, f"t{k % 2}", k, k / 2) for r in (1, 2, 7) for k in range(9)]
    FS.write_run_logs(spark.createDataFrame(rows, "run long, tag string, step long, value double"), str(tmp_path / "logs"), rows_per_file=4)
    back = spark.read.schema("run long, tag string, step long, value double").json(str(tmp_path / "logs"))
    assert sorted(map(tuple, back.select("run", "tag", "step", "value").collect())) == sorted(rows)
    # the task's own commit leaves nothing in the temporary folder for the driver to move
    source = open(FS.__file__).read()
    assert source.count("mapreduce.fileoutputcommitter.algorithm.version") == 1
