"""What the pipeline's stages leave on disk: shuffle files go with the write that made them, large tables once they have been used."""

import os
import random
import re
import time

import corpus_pipeline
from tagweave.llm import common, near_copies, suffixes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shuffles(spark):
    """Numbers of the shuffles that have files on disk."""
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {int(x) for x in re.findall(r"shuffle_(\d+)_", blocks)}


def left(spark, before):
    """Names of the tables written since, that are still there."""
    folder = common.shared_dir(spark).removeprefix("file://") + "/tagweave"
    return {x.rsplit("-", 1)[0] for x in os.listdir(folder) if x not in before}


def made(spark):
    rng = random.Random(4)
    words = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    common_part = words(60)
    texts = [words(80) for _ in range(30)]
    texts += [[*t[:-1], "changed"] for t in texts[:10]] + [words(30) + common_part + words(30) for _ in range(5)]
    return spark.createDataFrame([(i, " ".join(t), "en", "a", 1) for i, t in enumerate(texts)], SCHEMA)


def here(spark):
    folder = common.shared_dir(spark).removeprefix("file://") + "/tagweave"
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def test_shuffle_files_go_with_their_write(spark):
    held = [spark.range(1000).groupBy((common.F.col("id") % k).alias("k")).count() for k in (7, 11, 13)]
    before = shuffles(spark)
    tables = [common.stored(df, "counts") for df in held]
    until = time.time() + 10
    while shuffles(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffles(spark) - before
    assert [t.count() for t in tables] == [7, 11, 13] and [len(df.collect()) for df in held * 2] == [7, 11, 13] * 2


def test_near_duplicates_leave_no_large_table(spark):
    before = here(spark)
    kept = near_copies.one_of_each(made(spark))
    assert sorted(r["doc_id"] for r in kept.collect()) == [*range(30), *range(40, 45)]
    assert not left(spark, before) & {"classes", "recurring", "shared", "rooted", "mixed", "open", "likely", "needed", "sets", "open-sets", "open-shingles"}


def test_repeated_passages_leave_no_suffixes(spark):
    before = here(spark)
    out = suffixes.without_repeats(made(spark).filter("doc_id >= 40"))
    assert sorted(len(r["text"].split()) for r in out.collect()) == [60] * 4 + [120]
    assert not left(spark, before) & {"suffixes", "runs"}


def test_a_stages_rows_go_once_the_next_has_its_own(spark):
    before = here(spark)
    pieces = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert pieces.count() > 0
    assert left(spark, before) & {name for name, _ in corpus_pipeline.STAGES[:-1]} == {"decontamination"}


def test_only_stored_tables_are_dropped(spark):
    before = here(spark)
    table = common.stored(spark.range(3), "kept")
    same = table.filter("id > 0")
    common.dropped(same, spark.range(2))
    assert same.count() == 2 and left(spark, before) == {"kept"}
    common.dropped(table, table)
    assert not left(spark, before)
