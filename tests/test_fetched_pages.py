"""Fetched pages in batches and as a stream that goes on where it stopped."""

import json
import os

from pyspark.sql import functions as F

from threadloom.session import scratch_path
from threadloom.sources import fetched_pages


def put(folder, feed, page, rows):
    os.makedirs(f"{folder}/feed={feed}/page={page}", exist_ok=True)
    with open(f"{folder}/feed={feed}/page={page}/items.json", "w") as file:
        file.write("\n".join(json.dumps({"id": f"{feed}-{page}-{k}"}) for k in range(rows)))


def ids(df):
    return sorted(r[0] for r in df.select(F.get_json_object("item", "$.id")).collect())


def expected(feeds, pages, rows=3):
    return sorted(f"{f}-{p}-{k}" for f in feeds for p in pages for k in range(rows))


def test_conditions_leave_out_files(spark):
    folder = scratch_path(spark, "test-pages")
    for feed in ("a", "b c"):
        for page in range(6):
            put(folder, feed.replace(" ", "%20"), page, 3)
    df = fetched_pages.read_pages(spark, folder)
    assert len(ids(df)) == 36 and {r.feed for r in df.select("feed").distinct().collect()} == {"a", "b c"}
    some = df.filter((F.col("page") >= 2) & (F.col("page") < 4) & (F.col("feed") == "a") & F.col("item").contains("-1"))
    assert ids(some) == ["a-2-1", "a-3-1"]
    reader = fetched_pages.PageReader(folder)

    class GreaterThan:
        attribute, value = ("page",), 3

    class StringContains:
        attribute, value = ("item",), "x"

    rest = list(reader.pushFilters([GreaterThan(), StringContains()]))
    assert len(rest) == 1 and {p.number for part in reader.partitions() for p in part.pages} == {4, 5}
    assert fetched_pages.read_pages(spark, scratch_path(spark, "test-none")).count() == 0


def test_stream_goes_on_behind_its_offset(spark):
    folder, out, log = (scratch_path(spark, f"test-pages-{name}") for name in ("in", "out", "log"))
    fail = {"next": False}

    def run():
        def write(batch, number):
            path = f"{out}/batch={number}"
            batch.write.mode("overwrite").parquet(path)  # by number: a batch that runs again replaces itself
            if fail["next"]:
                fail["next"] = False
                raise RuntimeError("stopped in mid-stream")

        query = fetched_pages.stream_pages(spark, folder).writeStream.foreachBatch(write).option(
            "checkpointLocation", log).trigger(availableNow=True).start()
        query.awaitTermination()

    for page in range(3):
        put(folder, "a", page, 3)
    run()
    for page in (3, 4):
        put(folder, "a", page, 3)
    fail["next"] = True
    try:
        run()
        raise AssertionError("the batch has failed")
    except Exception as error:
        assert "stopped in mid-stream" in str(error)
    run()
    run()  # nothing new
    got = spark.read.parquet(out)
    assert ids(got) == expected("a", range(5)) == ids(fetched_pages.read_pages(spark, folder))
    assert got.select("batch").distinct().count() == 2
