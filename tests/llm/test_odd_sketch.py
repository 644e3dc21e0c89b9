"""Pairs that a sketch of odd counts shows to be too different never have their sets shuffled, and no link is lost."""

import numpy as np

from spreadlake.llm import ngram_join


def test_sketch_keeps_links_and_spares_sets(spark, monkeypatch):
    rng = np.random.default_rng(11)
    rows, pairs, links, far = [], [], set(), 0
    for k in range(60):
        n = int(rng.integers(1, 900))
        base = rng.integers(-(2**63), 2**63, 2 * n, dtype=np.int64)
        for j, kept in enumerate((1.0, 0.95, 0.87, 0.8, 0.3)):
            m = max(1, round(kept * n))
            found = np.unique(np.concatenate([base[:m], base[n : 2 * n - m]]))
            rows.append((10 * k + j, len(found), ngram_join.odd_sketch(found).tolist(), found.tolist()))
        first = set(rows[-5][3])
        for a in rows[-4:]:
            both = len(first & set(a[3]))
            pairs.append((a[0], rows[-5][0]))
            if 100 * both >= 75 * (len(first) + a[1] - both):
                links.add(pairs[-1])
            far += n > 200 and a[0] % 10 == 4
    sets = spark.createDataFrame(rows, "owner bigint, n bigint, odd array<bigint>, tokens array<bigint>")
    wanted, pruned = [], ngram_join.pruned
    monkeypatch.setattr(ngram_join, "pruned", lambda r, owners: wanted.append(owners) or pruned(r, owners))
    got = {(r.a, r.b) for r in ngram_join.verified(spark.createDataFrame(pairs, "a bigint, b bigint"), sets).collect()}
    assert got == links and 60 < len(links) < len(pairs)
    assert far > 20 and wanted[0].count() <= len(pairs) - far
