import json

import pytest
from mailsieve.operators.conform import number_rows
from mailsieve.operators.dedup import dedup_text
from mailsieve.sources.files import read_sources
from pyspark.sql import functions as F

from mailsieve.operators.linear import LinearSettings
from mailsieve.operators.tfidf import TfidfSettings
from mailsieve.plans.corpus import prepare
from mailsieve.plans.experiment import report_run, run_experiment
from mailsieve.sources import files


def _read_json(path):
    (file,) = list(path.glob("part-*.json"))
    return json.loads(file.read_text())


@pytest.fixture(scope="module")
def sources(spark, data, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sources")
    docs = spark.read.parquet(f"{data}/documents.parquet").join(
        spark.read.parquet(f"{data}/labels.parquet"), "doc_id"
    )
    rows = docs.select(
        F.concat(F.lit("d"), "doc_id").alias("id"), "text",
        F.when(F.col("doc_id") % 2 == 0, "sms").otherwise("email").alias("channel"),
        (F.col("doc_id") % 3 == 0).cast("int").alias("label"), "source", "lang",
    )
    files.write_source(rows.where("id > 'd4'"), str(folder), "b")
    files.write_source(rows.where("id <= 'd4'"), str(folder), "a")
    rows.where("id <= 'd2'").withColumn("label", F.col("label").cast("long")).withColumn("more", F.lit(1)).coalesce(
        1
    ).toPandas().to_parquet(folder / "c.parquet", index=False)
    return folder, rows


def test_read_sources(spark, sources, tmp_path):
    folder, rows = sources
    got = files.read_sources(spark, str(folder))
    assert got.columns == ["id", "text", "channel", "label", "source", "lang", "_file", "_row"]
    assert got.count() == rows.count() + rows.where("id <= 'd2'").count()
    assert {f.split("/")[0] for (f,) in got.select("_file").distinct().collect()} == {"a.parquet", "b.parquet", "c.parquet"}
    with pytest.raises(FileNotFoundError):
        files.read_sources(spark, str(tmp_path / "none"))
    (tmp_path / "empty").mkdir()
    with pytest.raises(RuntimeError, match="no parquet"):
        files.read_sources(spark, str(tmp_path / "empty"))
    rows.drop("lang").write.parquet(str(tmp_path / "bad" / "x.parquet"))
    with pytest.raises(ValueError, match="x.parquet misses columns: lang"):
        files.read_sources(spark, str(tmp_path / "bad"))


def test_prepare_fit_report(spark, sources, tmp_path):
    folder, rows = sources
    out = str(tmp_path / "out")
    found = {r["split"]: r for r in prepare(spark, str(folder), out, strict=False).collect()}
    unique = spark.read.parquet(f"{out}/messages")
    assert sum(r["rows"] for r in found.values()) == unique.count() <= rows.count()
    written = _read_json(tmp_path / "out" / "manifest")
    assert written["seed"] == 42 and set(written["splits"]) == {"train", "val", "test"}
    assert written["splits"]["val"]["sha256"] == found["val"]["sha256"]
    again = prepare(spark, str(folder), str(tmp_path / "out2"), strict=False)
    assert {r["split"]: r["sha256"] for r in again.collect()} == {k: v["sha256"] for k, v in found.items()}
    parts = [files.read_split(spark, f"{out}/splits", s) for s in files.SPLITS]
    assert parts[0].intersect(parts[1]).isEmpty() and parts[1].intersect(parts[2]).isEmpty()

    run = str(tmp_path / "run")
    settings = LinearSettings(TfidfSettings(max_features=300))
    metrics = run_experiment(spark, f"{out}/splits", run, settings)
    assert {r["split"]: r["n"] for r in metrics.collect()} == {s: found[s]["rows"] for s in ("val", "test")}
    saved = _read_json(tmp_path / "run" / "metrics")
    assert saved["splits"]["test"]["n"] == found["test"]["rows"] and saved["fit_seconds"] > 0
    assert saved["config"]["tfidf"]["max_features"] == 300
    report = report_run(spark, f"{out}/splits", run, "test")
    assert report.first()["subgroup"] == "overall" and report.first()["n"] == found["test"]["rows"]
    files.show_report(report)
    with pytest.raises(ValueError):
        report_run(spark, f"{out}/splits", run, "train")


def test_files_of_one_name_keep_their_places(spark, tmp_path):
    rows = [(f"m{i}", f"text {i % 12}", ("email", "sms")[i % 2], i % 2, "s", ("en", "fr")[i % 3 % 2]) for i in range(24)]
    df = spark.createDataFrame(rows, "id string, text string, channel string, label int, source string, lang string")
    for name in ("b", "a", "plain"):
        writer = df.withColumn("source", F.lit(name)).coalesce(1).write
        (writer if name == "plain" else writer.partitionBy("channel", "lang")).parquet(str(tmp_path / f"{name}.parquet"))
    placed = read_sources(spark, str(tmp_path))
    assert placed.count() == 72 and placed.select("_file", "_row").distinct().count() == 72
    kept = dedup_text(number_rows(placed), ("_n",)).collect()
    assert len(kept) == 12 and {r["source"] for r in kept} == {"a"}


def test_many_sources_of_one_schema_are_one_scan(spark, tmp_path):
    one = spark.createDataFrame([("i", "t", "sms", 0, "s", "en")], "id string, text string, channel string, label int, source string, lang string")
    one.coalesce(1).write.parquet(str(tmp_path / "first.parquet"))
    written = next((tmp_path / "first.parquet").glob("part-*.parquet")).read_bytes()
    for i in range(60):
        (tmp_path / f"s{i:02}.parquet").write_bytes(written)
    plan = read_sources(spark, str(tmp_path))
    assert plan.count() == 61
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
