"""A service of pages read as a table and as a stream."""

import json

import pytest
from pyspark.sql import functions as F

from quire.sources import service


def put(folder, page, records):
    (folder / f"page={page}").mkdir(parents=True)
    (folder / f"page={page}" / "part-0.json").write_text("\n".join(records))


@pytest.fixture
def served(spark, tmp_path):
    service.register(spark)
    for page in range(7):
        put(tmp_path, page, ["{broken"] if page == 5 else [json.dumps({"id": f"{page}.{n}", "body": f"é {page}"}) for n in range(page)])
    return tmp_path


def test_pages_are_read_by_ranges_and_failures_are_rows(spark, served):
    rows = spark.read.format("paged_service").option("path", str(served)).option("pagesPerTask", 2).load()
    assert rows.rdd.getNumPartitions() == 4
    got = rows.collect()
    assert sorted(r["id"] for r in got if r["error"] is None) == sorted(f"{p}.{n}" for p in range(7) if p != 5 for n in range(p))
    assert [(r["page"], r["id"], r["error"].split(":")[0]) for r in got if r["error"]] == [(5, None, "JSONDecodeError")]


def test_only_wanted_pages_are_asked_for(spark, served):
    rows = spark.read.format("paged_service").option("path", str(served)).option("pagesPerTask", 1).load()
    for where, pages in (("page >= 3 AND page < 5", {3, 4}), ("page = 6", {6}), ("page > 5 AND id <> '6.0'", {6}), ("page <= 2", {1, 2}), ("page = 1 AND page = 2", set()), ("page IN (1, 4)", {1, 4})):
        assert {r["page"] for r in rows.where(where).collect()} == pages
    assert rows.where("page >= 3 AND page < 5").rdd.getNumPartitions() == 2


def test_new_pages_come_as_a_stream(spark, served, tmp_path_factory):
    out = tmp_path_factory.mktemp("out")

    def run():
        query = spark.readStream.format("paged_service").option("path", str(served)).load().writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").start()
        query.processAllAvailable()
        query.stop()
        return {(r["page"], r["n"]) for r in spark.read.parquet(f"{out}/rows").groupBy("page").agg(F.count("*").alias("n")).collect()}

    first = run()
    assert first == {(1, 1), (2, 2), (3, 3), (4, 4), (5, 1), (6, 6)}
    put(served, 7, [json.dumps({"id": "new", "body": ""})])
    assert run() == first | {(7, 1)}


def test_an_empty_service(spark, tmp_path):
    service.register(spark)
    assert spark.read.format("paged_service").option("path", str(tmp_path)).load().count() == 0
