"""Queries that the n-gram join runs: those of large buckets only where there are any."""

import numpy as np

from spreadlake.llm import ngram_join


def test_no_blocks_without_large_buckets(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = []
    for k in range(12):
        words = [f"w{x}" for x in rng.integers(0, 10**6, 80)]
        rows += [(10 * k + j, " ".join([*words[:-1], f"end{j}"])) for j in range(3)]

    def refused(*_):
        raise AssertionError("compared in blocks")

    monkeypatch.setattr(ngram_join, "block_links", refused)
    monkeypatch.setattr(ngram_join, "ROUNDS", 1)
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id bigint, text string")).select("key", "component_id").collect()
    assert sorted(map(tuple, got)) == [(i, i - i % 10) for i, _ in rows]


def test_components_of_chains_and_stars(spark):
    rng = np.random.default_rng(9)
    names = (rng.permutation(400) * 7919 - 1_000_000).tolist()
    edges = [(names[i], names[i + 1]) for i in range(99)] + [(names[100], names[i]) for i in range(101, 160)]
    edges += [(names[x], names[y]) for x, y in rng.integers(200, 400, (120, 2)).tolist() if x != y]
    root = {x: x for e in edges for x in e}
    while any(root[a] != root[b] for a, b in edges):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = ngram_join.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r.node: r.root for r in got} == root and len(got) == len(root)
