"""HTML wrappers, Merkle manifest and hard negatives: plain versions, odd inputs, clashing columns."""

import hashlib
import json
import random
import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F
from spreadlake.llm import hard_negatives, merkle, queries, wrappers
from tests.conftest import SF

# --- op11 --------------------------------------------------------------------------------------

PAGE = "page_id long, url string, html string"


def pages_of(spark, rows, extra=()):
    df = spark.createDataFrame(rows, PAGE)
    for name in extra:
        df = df.selectExpr("*", f"'x' AS `{name}`")
    return df


def texts(df):
    return {r.page_id: r.text for r in wrappers.extract(df).collect()}


def site(i, body, nav="<a href='/a'>Home</a>"):
    return f"""<html><head><title>T {i}</title><style>p{{}}</style><script>if (a<b) x="</p><!-- ";</script></head><body>
      <header><h2>The Site</h2></header><nav><ul><li>{nav}</li><li>More</li></ul></nav>{body}
      <footer><p>Imprint &copy; us</p></footer></body></html>"""


def test_wrapper_cases(spark):
    rows = [
        (1, "http://a.org/1", site(1, "<article><h1>One  &amp;\n two</h1><p>First <b>bold</b>text.</p><div class='ad-box'>Buy</div><p>Second&#33;<br>line</p><aside>side</aside><form><label>Mail</label><p>give it</p></form><section id='comments'><h3>Comments</h3><p>me too</p></section></article><div class=sidebar><p>Side words that go on and on</p></div>")),
        (2, "http://a.org/2", site(2, "<div class='cookie-notice'>We use cookies</div><article><header><h1>Two</h1></header><p>Only<p>unclosed <li>item<li>next</article><div class='comments'><article class='comment'><p>reader says</p></article></div>")),
        (3, "http://b.org/1", site(3, "<div class='has-sidebar'><div id='main-content'><h1>Three</h1><p>Main part</p></div><div class='sidebar'>no</div></div>")),
        (4, "http://c.org/1", site(4, "<div><p>Free words of the fourth page, which are many and stand alone.</p><ul><li><a href='x'>link link link</a></ul></div><div>Terms</div>")),
        (5, "http://c.org/2", site(5, "<div><p>Other free words of another page, longer than anything around it.</p><ul><li><a href='y'>more links here</a></ul></div><div>Terms</div>")),
        (6, "http://c.org/3", site(6, "<div><p>A third page with its own free words, again longer than the frame.</p></div><div>Terms</div>")),
        (7, None, "no tags at all,  just\ttext &lt;here&gt;"),
        (8, "http://a.org/8", None),
        (9, "", ""),
        (10, "http://d.org", "<article>a < b & c <3 <p title='x>y'>q</p><!-- no > --><span class='ad'>x <span>y</span> z</span>w</article> tail"),
        (11, "http://d.org", "<script>never closed <article>hidden</article>"),
        (12, "http://e.org", "<article class='commentary'>kept</article><article hidden>gone</article>"),
        (13, "http://f.org", "<div>" * 3000 + "deep" + "</div>" * 3000),
        (14, "http://f.org/x", "<article>" + "".join(f"<p>row {i}</p><h2 class='k{chr(97 + i % 26)}{'x' * (i % 60)}'>h{i}</h2>" for i in range(3000)) + "</article>"),
        (14, "http://f.org/x", "<article><p>again</p></article>"),
        (None, "http://f.org/x", "<main><p>null id</p><nav>menu</nav></main>"),
    ]
    for extra in ((), ("text", "n_chars", "host", "wrapper", "page_host", "page_wrapper", "pages", "slot")):
        got = [(r.page_id, r.text, r.n_chars) for r in wrappers.extract(pages_of(spark, rows, extra)).collect()]
        assert len(got) == len(rows) and all(n == len(t) for _, t, n in got)
        by = {k: t for k, t, _ in got if k != 14}
        assert by[1] == "One & two\nFirst boldtext.\nSecond! line"
        assert by[2] == "Two\nOnly\nunclosed\nitem\nnext"
        assert by[3] == "Three\nMain part"
        assert by[4].startswith("Free words") and "link" not in by[4] and "Terms" not in by[4]
        assert by[6] == "A third page with its own free words, again longer than the frame."
        assert by[7] == "no tags at all, just text <here>"
        assert by[8] == by[9] == by[11] == ""
        assert by[10] == "a < b & c <3\nq\nw"
        assert by[12] == "kept" and by[13] == "deep" and by[None] == "null id"
        long = sorted(t for k, t, _ in got if k == 14)
        assert long[0] == "again" and long[1].split("\n") == [x for i in range(3000) for x in (f"row {i}", f"h{i}")]
    assert wrappers.extract(pages_of(spark, [])).count() == 0


def test_copies_of_one_page_keep_their_text(spark):
    html = "<div><p>The same words on every copy of this page.</p></div>"
    got = texts(pages_of(spark, [(i, "http://g.org", html) for i in range(9)]))
    assert set(got.values()) == {"The same words on every copy of this page."}


def expression_of(*htmls):
    whole = None
    for html in htmls:
        node = wrappers.read(wrappers.written(wrappers._folded_page(html)[0], True))
        whole = node if whole is None else wrappers.merge(whole, node)
    return wrappers.expression(whole)


def test_expressions():
    """Repeats fold, mismatches become optional, groups repeat as a whole, long mixed lists become one group."""
    assert expression_of("<ul><li>a<li>b<li>c</ul>") == "<html> <ul> (<li> # </>)+ </> </>"
    assert expression_of("<p>a</p>", "<p>a</p><p>b</p>") == "<html> (<p> # </>)+ </>"
    assert expression_of("<h1>a</h1><p>x</p>", "<h1>b</h1><table><tr><td>1</table><p>y</p>") == "<html> <h1> # </> (<table> <tr> <td> # </> </> </>)? <p> # </> </>"
    assert expression_of("<dl><dt>a<dd>b<dt>c<dd>d<dd>e<dt>f<dd>g</dl>") == "<html> <dl> (<dt> # </> (<dd> # </>)+)+ </> </>"
    assert expression_of("<dl><dt>a<dd>b</dl>", "<dl><dt>a<dd>b<dt>c<dd>d</dl>") == "<html> <dl> (<dt> # </> <dd> # </>)+ </> </>"
    rng = random.Random(3)
    mixed = "".join(f"<h{rng.randint(1, 6)}>x</h1>" if rng.random() < 0.5 else f"<div class='{rng.choice('abcdefg')}'>y</div>" for _ in range(2000))
    assert len(expression_of(mixed, "<p>z</p>" + mixed)) < 1000
    # the order of pages does not matter for what is accepted: every slot of a page has its place
    a, b = (wrappers._folded_page(x)[0] for x in ("<p>a</p><ul><li>b</ul>", "<ul><li>c</ul><p>d</p><p>e</p>"))
    whole = json.dumps(wrappers.written(wrappers.merge(*(wrappers.read(wrappers.written(x, True)) for x in (a, b))), True))
    assert all(f[4] > 0 for page in (a, b) for f in wrappers.matched_figures(page, whole))


def test_many_skeletons_of_one_host(spark):
    """More layouts than one task aligns: the wrappers are aligned again, and each host has one."""
    rng = random.Random(5)
    rows = []
    for i in range(300):
        frame = "".join(f"<div class='box{chr(97 + rng.randint(0, 7))}'>frame</div>" for _ in range(rng.randint(0, 6)))
        rows.append((i, "http://hot.org", f"<nav>menu</nav>{frame}<article><h1>t{i}</h1>{'<p>w</p>' * rng.randint(1, 3)}</article>{frame}"))
    df = pages_of(spark, rows)
    found = wrappers.infer(df).collect()
    assert len(found) == 1 and found[0].host == "hot.org"
    assert {k: t.split("\n")[0] for k, t in texts(df).items()} == {i: f"t{i}" for i in range(300)}


# --- op12 --------------------------------------------------------------------------------------


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_tree(leaves):
    """Root and, for each leaf, the siblings from the bottom up and the fold of another leaf."""
    level, paths = list(leaves), [[] for _ in leaves]
    where = list(range(len(leaves)))
    while len(level) > 1:
        for i, w in enumerate(where):
            run = level[w // 8 * 8 : w // 8 * 8 + 8]
            paths[i].append((run[: w % 8], run[w % 8 + 1 :]))
        level, where = [H(*level[k : k + 8]) for k in range(0, len(level), 8)], [w // 8 for w in where]
    return level[0], paths


def plain_merkle(rows):
    """rows: (doc_id, source, lang, n_chars, text)"""
    leaf = lambda r: H(*[field(v) for v in r])
    low = lambda t: None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees, out = {}, []
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[lang] = (own, *plain_tree([leaf(r) for r in own]))
    root, tops = plain_tree([trees[x][1] for x in langs])
    for k, lang in enumerate(langs):
        own, sub, paths = trees[lang]
        for r, path in zip(own, paths):
            whole = path + tops[k]
            now = (*r[:4], low(r[4])) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else r
            node = leaf(now)
            for before, after in whole:
                node = H(*before, node, *after)
            out.append((r[0], leaf(r), sub, root, H(*[s for b, a in whole for s in b + a]), node, node == root))
    return sorted(out, key=str)


DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def merkle_rows(df):
    done = merkle.verify(df).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted((tuple(r) for r in done.collect()), key=str)


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 8, "de": 1}, {None: 9, "": 2, "en": 75, "é": 64, "ê": 65}, {f"l{i:02}": i % 3 + 1 for i in range(20)}])
def test_merkle(spark, sizes):
    rng, rows = random.Random(4), []
    for lang, n in sizes.items():
        for _ in range(n):
            i = len(rows)
            rows.append((rng.choice([i, i, i, 3, None]), rng.choice(["s", None, ""]), lang, rng.choice([None, i]), rng.choice([None, "", "Ab Cé", "x" * 70_000, "\U0001f600"])))
    rows += rows[:3]
    df = spark.createDataFrame(rows, DOCS)
    want = plain_merkle(rows)
    assert merkle_rows(df) == want
    # names that the operator uses itself
    for name in ("tree", "rank", "leaf", "digest", "path", "chunk", "now", "n"):
        df = df.selectExpr("*", f"'x' AS `{name}`")
    assert merkle_rows(df) == want
    assert {r[6] for r in want if r[5] == r[3]} == {True}


def test_merkle_empty_and_records(spark):
    empty = spark.createDataFrame([], DOCS)
    assert merkle.verify(empty).collect() == []
    rows = [(i, "s", "en", 1, "t") for i in range(70)]
    df = spark.createDataFrame(rows, DOCS)
    leaves = df.select("doc_id", F.lit("=en").alias("tree"), merkle.leaf_of().alias("leaf"))
    m = merkle.manifest(leaves, ["doc_id"], ["doc_id"])
    records = {r.digest: list(r.children) for r in m.records.collect()}
    assert len(records) == 9 + 2 + 1 and all(d == H(*c) for d, c in records.items())
    found = merkle.proofs(m).select("rank", "leaf", merkle.fold(F.col("leaf"), F.col("path")).alias("root")).collect()
    assert len(found) == 70 and {r.root for r in found} == {m.root}


# --- op13 --------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<double>, label int"


def plain_mine(rows):
    took = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        took.append((i, [int(np.floor(256 * x)) for x in v], (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for a, (i, v, label) in enumerate(took):
        if i % 100:
            continue
        scores = [(-sum(x * y for x, y in zip(v, w)), j, k) for b, (j, w, k) in enumerate(took) if b != a]
        for s, j, _ in sorted(x for x in scores if x[2] == label)[:5]:
            bad = sorted(x for x in scores if x[2] != label and 80 * -s <= 100 * -x[0] <= 100 * -s)[:5]
            out += [(i, j, r + 1, n, -s, -t) for r, (t, n, _) in enumerate(bad)]
    return sorted(out)


def mined(df):
    return sorted(tuple(r) for r in hard_negatives.mine(df).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def vector_rows(n, seed, wide=1.0):
    rng = np.random.default_rng(seed)
    rows = [(i * 5, [float(x) for x in rng.normal(0.1, 0.3, 6) * wide], int(rng.integers(0, 3))) for i in range(n)]
    rows += [rows[4]] * 7 + [rows[20]] * 3 + [(rows[9][0], rows[1][1], 1), (7000, rows[3][1], 2), (7100, [], 1), (7200, [0.5], 1)]
    odd = [(100, None, 1), (200, [1.0, None], 1), (300, [float("nan")] * 6, 1), (400, [float("inf")] * 6, 1), (500, [1.0] * 6, None), (None, [1.0] * 6, 1)]
    return rows + odd


@pytest.mark.parametrize("wide", [1.0, 2000.0, 1e7])
def test_hard_negatives(spark, wide):
    rows = vector_rows(200, 3, wide)
    df = spark.createDataFrame(rows, VECTORS)
    want = plain_mine(rows)
    assert len(want) > 20
    assert mined(df) == want
    for name in ("id", "row", "copies", "block", "part", "anchor", "positive", "rank", "score"):
        df = df.selectExpr("*", f"'x' AS `{name}`")
    assert mined(df) == want


def test_hard_negatives_small_blocks(spark, monkeypatch):
    """Many blocks of anchors, groups of candidates and strips give the same rows; so do tables without rows or anchors."""
    rows = vector_rows(150, 8)
    df = spark.createDataFrame(rows, VECTORS)
    want = plain_mine(rows)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 3)
    monkeypatch.setattr(hard_negatives, "CANDIDATES", 40)
    monkeypatch.setattr(hard_negatives, "CELLS", 20)
    assert mined(df) == want
    assert mined(df.limit(0)) == [] and mined(df.filter("vec_id % 100 <> 0")) == []


@pytest.mark.parametrize("low,high", [(-3, 4), (-150, 150), (-(2**15), 2**15), (-(2**30), 2**30), (-(2**70), 2**70), (0, 1)])
def test_packed_products(low, high):
    rng = random.Random(1)
    make = lambda n: np.array([[rng.randint(low, high - 1) for _ in range(9)] for _ in range(n)], dtype=object)
    a, c = make(4), make(11)
    if high <= 2**31:
        a, c = a.astype(np.int64), c.astype(np.int64)
    got = hard_negatives.products(a, c)
    assert [[int(x) for x in r] for r in got] == [[sum(int(x) * int(y) for x, y in zip(p, q)) for q in c] for p in a]
    assert hard_negatives.products(a, c[:0]).shape == (4, 0)


def test_new_queries_on_given_tables(spark):
    import duckdb

    from tools.check import TABLES, normal

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name in ("op11_html_wrappers", "op12_merkle_manifest", "op13_hard_negatives"):
        got, want = normal(queries.QUERIES[name](spark, SF).toPandas()), normal(con.execute(queries.ORACLES[name]).df())
        assert len(got) and got.equals(want), name
