"""The pipeline's stages, each on what its predecessor kept, against plain versions."""

import numpy as np

import __spark_entry__ as entry
import corpus_pipeline
from spreadlake.llm import line_dedup
from tests.conftest import SF
from tests.llm import reference as ref


def rows_of(df):
    return [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    benchmark = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = [rows_of(docs)]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        kept.append(rows_of(docs))
    source, quality, lines, near, clean = kept
    assert {k for k, _, _ in quality} <= {k for k, _, _ in source} and all(labels[k] == 0 for k, _, _ in set(source) - set(quality) if k in labels)
    assert len(quality) < len(source)
    want = [(k, x[0], host) for (k, _, host), x in zip(quality, ref.site_lines(quality, line_dedup.RATIO, line_dedup.LEAST_PAGES))]
    assert sorted(lines) == sorted(want)
    found = ref.near([(k, t) for k, t, _ in lines])
    assert sorted(near) == sorted(row for row, (n, first) in zip(lines, found) if not n or first == row[0])
    windows = ref.windows(benchmark)
    assert sorted(clean) == sorted(row for row in near if not ref.contamination(row[1], windows)[-1])
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).toPandas()
    assert set(pieces["doc_id"]) == {k for k, _, _ in clean}
    per_doc = pieces.groupby("doc_id").agg(n=("length", "sum"), tokens=("doc_tokens", "max"))
    assert (per_doc["n"] == per_doc["tokens"]).all() and np.all(pieces.groupby("sequence_id")["length"].sum() <= 2048)


def test_run_equals_stages(spark):
    whole = entry.queries()["pipeline"](spark, SF)
    assert whole.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and whole.count() > 50
    assert "pipeline" not in entry.oracle_sql()


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
