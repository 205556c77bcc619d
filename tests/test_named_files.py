import os

from pyspark.sql import functions as F

from benchset import derived
from grouptrace.sources import readers, sinks


def written(folder):
    return {f: open(f"{folder}/{f}", encoding="utf-8", newline="").read() for f in sorted(os.listdir(folder))}


def test_one_file_for_each_name(spark, tmp_path):
    lines = [("b 1+2%41.json", 2, "two"), ("b 1+2%41.json", 1, "oné"), ("a.json", 1, None), (None, 1, "lost"), ("a.json", 2, "x\ny")]
    df = spark.createDataFrame(lines, "f string, n int, t string").withColumn("h", F.lit("first")).repartition(3)
    for folder in (str(tmp_path / "plain"), f"file://{tmp_path}/uri"):
        assert sinks.write_named_files(df, folder, "f", "t", ["n"], "h") == 2
    assert written(tmp_path / "plain") == {"a.json": "first\n\nx\ny\n", "b 1+2%41.json": "first\noné\ntwo\n"}
    assert written(tmp_path / "uri") == written(tmp_path / "plain")


def test_documents_are_written_by_many_tasks_without_a_call_for_each(spark, tmp_path, monkeypatch):
    """A file is not laid out in a folder of its own that one task writes and the driver renames."""
    monkeypatch.setattr(derived, "work_path", lambda _, label: str(tmp_path / label))
    documents = spark.range(400).selectExpr(
        """concat('{"response":{"corporation":{"corpRegisterIndex":"', id, '-112"}}}') as value""").coalesce(1)
    tasks = []
    write = sinks.write_named_files

    def counted(lines, *rest):
        group = spark.sparkContext.statusTracker()
        before = set(group.getJobIdsForGroup(None) or [])
        files = write(lines, *rest)
        for job in set(group.getJobIdsForGroup(None)) - before:
            tasks.extend(group.getStageInfo(s).numTasks for s in group.getJobInfo(job).stageIds if group.getStageInfo(s))
        return files

    monkeypatch.setattr(derived, "write_named_files", counted)
    spark.conf.set("spark.sql.shuffle.partitions", 7)
    try:
        folder = derived.Inputs(spark, str(tmp_path)).document_folder(lambda: documents)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 2)
    assert os.listdir(tmp_path) == ["document-files"] and 7 in tasks
    assert sorted(os.listdir(folder)) == sorted(f"{i}-112.json" for i in range(400))
    assert readers.read_json_documents(spark, folder, "response struct<corporation: struct<corpRegisterIndex: string>>").count() == 400


def test_batches_are_written_in_one_job_as_spark_writes_them(spark, tmp_path):
    """All batches in one write; a driver call for each file would have made a folder for each."""
    cells = spark.createDataFrame(
        [("f 1.csv", 2, 'a "b", c', None, 1.5), ("f 1.csv", 1, "", "x\ny ", None)], "file_name string, row int, plain string, other string, v double")
    cells = cells.withColumnRenamed("other", "two\nlines")
    lines = derived.csv_lines(cells, "file_name", "row")
    assert sinks.write_named_files(lines, str(tmp_path / "new"), "file_name", "line", ["row"], "header") == 1
    cells.coalesce(1).orderBy("row").drop("file_name", "row").write.option("header", True).option("escape", '"').csv(str(tmp_path / "spark"))
    spark_file = next(f for f in os.listdir(tmp_path / "spark") if f.endswith(".csv"))
    assert written(tmp_path / "new") == {"f 1.csv": (tmp_path / "spark" / spark_file).read_text()}
