from __future__ import annotations

import datetime as dt
import shutil

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In

from jobloom.sources import datasource, fixtures, schemas, store

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("written")
    store.ParquetStore(spark, str(folder), parts=2).save_jobs(fixtures.raw_jobs(spark, SF))
    return folder


@pytest.fixture
def filled(spark, written, tmp_path):
    datasource.register(spark)
    shutil.copytree(written, tmp_path / "queue")
    return store.ParquetStore(spark, str(tmp_path / "queue"), parts=2)


def read(spark, s):
    return spark.read.format("jobloom").load(s.path)


def test_the_table_is_read_by_name(spark, filled):
    rows = read(spark, filled)
    assert rows.columns == schemas.names(schemas.JOBS)
    assert sorted(map(str, rows.collect())) == sorted(map(str, filled.jobs().collect()))
    few = spark.read.format("jobloom").schema("id string, status string").load(filled.path)
    assert sorted(few.collect()) == sorted(filled.jobs().select("id", "status").collect())
    with pytest.raises(Exception, match="path"):
        spark.read.format("jobloom").load().count()
    filled.reset()
    assert read(spark, filled).count() == 0


def test_filters_give_what_they_give_on_the_table(spark, filled):
    day = filled.jobs().agg(F.max("completed_at")).first()[0] - dt.timedelta(days=200)
    for condition in ("status = 'pending'", "status IN ('active', 'failed')", f"completed_at >= timestamp_ntz'{day}'", f"completed_at < timestamp_ntz'{day}'", "status = 'pending' AND status = 'failed'", "priority > 2 AND dedupe_key IS NULL", "status <> 'pending'"):
        assert sorted(r.id for r in read(spark, filled).filter(condition).collect()) == sorted(r.id for r in filled.jobs().filter(condition).collect()), condition


def test_filters_prune_files(spark, filled):
    schema = read(spark, filled).schema

    def files(*filters):
        reader = datasource.JobReader(filled.path, schema)
        assert list(reader.pushFilters(list(filters))) == list(filters)
        return [p.path for p in reader.partitions()]

    everything = files()
    opened = files(EqualTo(("status",), "pending"))
    assert opened and all("area=open" in f for f in opened) and len(opened) < len(everything)
    assert set(files(In(("status",), ("pending", "failed")))) == set(everything)
    late = files(EqualTo(("status",), "completed"), GreaterThanOrEqual(("completed_at",), dt.datetime(9000, 1, 1)))
    assert late == []


def test_offsets_follow_the_change_log(spark, filled):
    reader = datasource.ChangeReader(filled.path, read(spark, filled).schema, False)
    assert reader.initialOffset() == reader.latestOffset() == {"batch": 0}
    one = spark.createDataFrame(filled.jobs().filter("status = 'active'").limit(1).collect(), schemas.JOBS)
    filled.update(one.withColumn("status", F.lit("pending")), one, {})
    assert reader.latestOffset() == {"batch": 1}
    got = [r for f in reader.partitions({"batch": 0}, {"batch": 1}) for b in reader.read(f) for r in b.to_pylist()]
    assert [(r["id"], r["status"]) for r in got] == [(one.first().id, "pending")]


def test_a_batch_that_is_in_the_change_log_is_done(spark, filled):
    one = spark.createDataFrame(filled.jobs().filter("status = 'active'").limit(1).collect(), schemas.JOBS)
    filled.update(one.withColumn("status", F.lit("pending")), one, {})
    # the writer died before it forgot the batch
    spark.range(1).write.parquet(f"{filled.path}/unfinished/ready")
    filled.recover()
    assert filled._changes() == [0] and not filled._exists("unfinished")
    assert filled.jobs().filter(F.col("id") == one.first().id).first().status == "pending"
