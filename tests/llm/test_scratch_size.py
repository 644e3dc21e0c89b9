"""What a staged table and a verification leave on disk and send through a shuffle."""

import glob
import os
import time

from pyspark.sql import functions as F

from spreadlake.llm import common, ngram_join


def shuffle_files(spark) -> set[str]:
    folder = spark.conf.get("spark.local.dir", "/tmp")
    return {p for p in glob.glob(f"{folder}/**/blockmgr-*/**/shuffle_*", recursive=True) if os.path.getmtime(p) > spark.sparkContext.startTime / 1000}


def test_a_staged_table_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    table = common.staged(spark.range(10_000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count())
    until = time.time() + 20
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    assert not left
    assert sorted(r["count"] for r in table.collect()) == [1428] * 3 + [1429] * 4
    assert spark.conf.get(common.DROP_SHUFFLES) == "false"


def test_pruned_keeps_all_wanted_rows_and_few_others(spark):
    sets = spark.range(20_000).select(F.xxhash64("id").alias("owner"), "id")
    wanted = sets.filter("id % 100 = 0")
    got = {r.id for r in ngram_join.pruned(sets, wanted.select("owner")).collect()}
    assert {r.id for r in wanted.collect()} <= got and len(got) < 400
    assert ngram_join.pruned(sets, wanted.filter("id < 0").select("owner")).count() == 0
