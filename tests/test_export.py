"""The published export: all tables with their schemas, a manifest that tells what changed, refusals."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from evalbench.operators import export as op
from evalbench.plans import export as plan

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def published(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("export")
    built = op.Export(*plan.relations(spark, SF), "salt", 50).tables()
    manifest = op.publish(spark, built, f"file://{base}/out")
    return f"{base}/out", built, manifest


def test_tables_and_manifest(spark, published):
    path, built, manifest = published
    assert len(built) == 13 and not os.path.exists(f"{path}.partial")
    for name, df in built.items():
        wanted = spark.createDataFrame([], op.SCHEMAS[name]).schema
        assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in wanted]
        back = spark.read.schema(wanted).parquet(f"file://{path}/tables/{name}.parquet")
        assert back.exceptAll(df).count() == df.exceptAll(back).count() == 0
        text = spark.read.schema(wanted).option("header", True).csv(f"file://{path}/tables/{name}.csv")
        assert text.count() == df.count()
    files = {f"tables/{f.split('/tables/')[1]}": os.path.getsize(f) for f in glob.glob(f"{path}/tables/*/part-*")}
    assert {r.file: r.bytes for r in manifest.collect()} == files
    assert op.verify(spark, f"file://{path}").count() == 0
    row = built["reconciliation"].first()
    assert (row.status, row.console_gross_usd) == ("not_reconciled", None)
    assert built["pareto_frontier"].where("pareto").count() == built["marginal_cost_quality"].count() > 0


def test_names_are_salted(spark, published):
    relations = plan.relations(spark, SF)
    hashes = {r.config_hash for r in relations[1].collect()}
    ids = {r.public_config_id for r in published[1]["leaderboard"].collect()}
    other = {r.public_config_id for r in op.Export(*relations, "other").table("leaderboard").collect()}
    assert len(ids) == 12 and not ids & hashes and not ids & other


def test_refusals(spark, published, tmp_path):
    path, built, _ = published
    with pytest.raises(ValueError, match="already"):
        op.publish(spark, built, f"file://{path}")
    results, configs, usage, failures = plan.relations(spark, SF)
    with pytest.raises(ValueError, match="different questions"):
        op.Export(results.where("not (experiment_id = 'e01' and question_id < '5')"), configs, usage, failures, "s").table("parse_paired_difference")
    with pytest.raises(ValueError, match="not enough"):
        op.Export(results, configs, usage, failures.limit(3), "s").table("failure_sample_plan")
    none = op.Export(results.where("false"), configs, usage.where("false"), failures, "s")
    assert none.table("leaderboard").count() == 0 and none.table("cost_breakdown").count() == 0 and none.table("reconciliation").first().local_gross_usd == 0


def test_what_changed_is_told(spark, published):
    path = published[0]
    parts = sorted(glob.glob(f"{path}/tables/top_k_tradeoff.csv/part-*"))
    extra = os.path.dirname(parts[0]) + "/part-99999-x.csv"
    for crc in glob.glob(os.path.dirname(parts[0]) + "/.*.crc"):
        os.remove(crc)
    open(parts[0], "a").write("1,2\n")
    open(extra, "w").write("x\n")
    os.remove(glob.glob(f"{path}/tables/leaderboard.csv/part-*")[0])
    found = {(r.file.split("/")[1], r.problem) for r in op.verify(spark, f"file://{path}").collect()}
    assert found == {("top_k_tradeoff.csv", "changed"), ("top_k_tradeoff.csv", "extra"), ("leaderboard.csv", "missing")}
