"""Pages that land in several batches: whole drawings, waiting, late and repeated pages."""

import time

from tagweave.streaming import landing


def words(drawing, page, pages, *texts):
    rows = [(drawing, page * 100 + k, page, t, 90.0, 100.0 + 200 * k, 50.0 * page, 160.0 + 200 * k, 50.0 * page + 20, "page", pages) for k, t in enumerate(texts)]
    return rows or [(drawing, None, page, None, None, None, None, None, None, None, pages)]


def test_pages_in_any_order_and_batches(spark, tmp_path):
    """The stateful operator alone: what it lets go, and when."""
    paths = [str(tmp_path / x) for x in ("landing", "out", "checkpoint")]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", landing.ROCKS)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")

    def run(number, *rows, wait_ms=3_600_000):
        spark.createDataFrame([r for part in rows for r in part], landing.LANDED).coalesce(1).write.parquet(f"{paths[0]}/{number}")
        stream = spark.readStream.schema(landing.LANDED).parquet(paths[0] + "/*")
        query = landing.held_drawings(stream, wait_ms).writeStream.option("checkpointLocation", paths[2]).trigger(availableNow=True).start(paths[1], format="parquet")
        query.awaitTermination(120)
        assert query.exception() is None
        return sorted((r["drawing_id"], r["revision"], r["complete"], r["page"] or 0, r["text"]) for r in spark.read.parquet(paths[1]).collect())

    d1, d2 = words("d", 1, 2, "PT-1001", "note"), words("d", 2, 2, "FCV-2002")
    e = [("e", 0, True, 1, "TI-3003")]
    assert run(1, d2, words("e", 1, 1, "TI-3003")) == e
    both = [("d", 0, True, 1, "PT-1001"), ("d", 0, True, 1, "note"), ("d", 0, True, 2, "FCV-2002")]
    assert run(2, d2) == e  # the same page again
    # f lacks its second page: what came goes out when the wait is over; g has no words
    run(3, d1, words("f", 1, 2, "LI-4004"), wait_ms=1)
    time.sleep(0.1)
    f, g = [("f", 0, False, 1, "LI-4004")], [("g", 0, True, 0, None)]
    assert run(4, words("g", 1, 1), wait_ms=1) == both + e + f + g
    # late pages are a revision of their own
    assert run(5, words("f", 1, 2, "LI-4005"), words("f", 2, 2, "PI-5005")) == both + e + f + [("f", 1, True, 1, "LI-4005"), ("f", 1, True, 2, "PI-5005")] + g


def test_landed_pages_become_tags(spark, tmp_path):
    paths = [str(tmp_path / x) for x in ("landing", "out", "checkpoint")]
    rows = words("d", 2, 2, "FCV-2002") + words("e", 1, 1) + words("d", 1, 2, "PT-1001", "note") + words("f", 1, 2, "LI-4004")
    spark.createDataFrame(rows, landing.LANDED).coalesce(1).write.parquet(f"{paths[0]}/1")
    query = landing.watch_pages(spark, paths[0] + "/*", *paths[1:], once=True)
    query.awaitTermination(200)
    assert query.exception() is None
    found = spark.read.option("recursiveFileLookup", "true").parquet(paths[1]).collect()
    assert sorted((r["drawing_id"], r["revision"], r["complete"], r["page"] or 0, r["text"]) for r in found) == [("d", 0, True, 1, "PT-1001"), ("d", 0, True, 2, "FCV-2002"), ("e", 0, True, 0, None)]
