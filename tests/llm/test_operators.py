"""Each operator against its plain version: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import json
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from pyspark.sql import functions as F
from spreadlake.llm import chat, decontaminate, licenses, line_dedup, line_rules, ngram_join, packing, pii, quality, queries, toxicity
from tests.conftest import SF
from tests.llm import reference as ref
from tools.check import TABLES, normal

WORDS = [a + b for a in ("ka", "lo", "mi", "tu", "re", "so", "ne", "vi") for b in ("ran", "del", "pos", "tim", "gur", "bex", "fol", "wen")]


def prose(seed, n, per_line=9):
    rng = random.Random(seed)
    said = [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n)]
    return "\n".join(" ".join(said[i : i + per_line]) + "." for i in range(0, n, per_line))


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (None, "Ünïcode ünïcode x"), (5, "a b\x1cc\x0bd"), (6, "x" * 50_000), (7, prose(1, 30_000)), (8, "\U0001f600 emoji <|endoftext|> tail"), (9, "ABC\r\nabc\n\nABC\r")]


# --- op1 ---------------------------------------------------------------------------------------

PII_TEXTS = [
    (20, "mail a.b@c.de and x@y, z@@q.r s@t.u@v.w"), (21, "ip 1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 007.0.0.1"),
    (22, "card 4111 1111 1111 1111 and 4111-1111-1111-1112 5"), (23, "call +1 (743) 555-3824 or +12 or +1-2-3-4-5-6-7-8-9-0"),
    (24, "call +1 (743) 555-3824 today\nagain (743) 555-3824 and 7435553824"), (25, "@" * 3000), (26, "1" * 30_000), (27, "1 " * 5000 + "+1" * 2000), (28, "é@é.é ü+1 222 333 4444é"),
]


@pytest.mark.parametrize("extra", [False, True])
def test_pii(spark, docs_of, extra):
    rows = ODD + PII_TEXTS
    got = pii.find(docs_of(rows, extra)).toPandas()
    assert len(got) == len(rows)
    want = sorted((str(k), ref.pii(t)) for k, t in rows)
    assert sorted((str(None if k != k else int(k)), b) for k, b in zip(got["doc_id"], got["base"])) == want
    for r in got.itertuples():
        assert r.base_sha256 == hashlib.sha256(r.base.encode()).hexdigest()
        assert set(filter(None, r.base.split(","))) <= set(r.spans.split(","))
    assert pii.find(docs_of([])).count() == 0


def test_skip_chain_carries_labels(spark):
    """A number that stands once with and once without its prefix gets the label there too; a lone number doesn't."""
    train = [f"word call +1 ({100 + i}) 555-{1000 + i} now or write n{i}@h{i}.org and ref {i} of {i * 7} call +1 ({100 + i}) 555-{1000 + i}" for i in range(300)]
    field = pii.Field([pii.nodes(t, pii.base_spans(t)) for t in train])
    weights = pii.fit(field)
    assert weights["skip"][0] > 0
    text = "call +1 (743) 555-3824 today and once more 555-3824 said"
    base = pii.base_spans(text)
    found = pii.nodes(text, base)
    alone = pii.nodes("and once more 555-3824 said", [])
    p, q = pii.marginals(pii.Field([found]), weights), pii.marginals(pii.Field([alone]), weights)
    assert p[3, 4] > q[0, 4]
    # documents in one batch don't influence each other
    both = pii.marginals(pii.Field([alone, found]), weights)
    assert np.allclose(both[:1], q) and np.allclose(both[1:], p)


# --- op2 ---------------------------------------------------------------------------------------


def turn_records(df):
    return chat.record_turns(df.select("conv_id", F.to_variant_object(F.struct("turn", "role", "text")).alias("record")), "conv_id")


def read_back(df, id_col="id"):
    done = chat.format_turns(df).select(id_col, "layout", "formatted", chat.read_turns(F.col("formatted")).alias("read"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    return {r[id_col]: (r["layout"], [(t["role"], t["text"]) for t in r["read"]], list(r["loss"]), r["formatted"]) for r in done.collect()}


def test_chat_layouts(spark):
    """Heterogeneous records choose their mapping by fingerprint; unknown layouts keep their row without turns."""
    kind = "id int, prompt string, response string, system string, messages array<struct<role:string,content:string>>, conversations array<struct<`from`:string,value:string>>, instruction string, input string, output string, junk string"
    rows = [
        (1, "p", "r", None, None, None, None, None, None, None), (2, "p", "r", "s", None, None, None, None, None, None),
        (3, None, None, None, [("user", "a"), ("assistant", "b\n"), None, (None, None)], None, None, None, None, None),
        (4, None, None, None, None, [("human", "q"), ("gpt", "w")], None, None, None, None), (5, None, None, None, None, None, "i", "in", "o", None),
        (6, None, None, None, None, None, "i", None, "o", None), (7, None, None, None, None, None, None, None, None, "odd"), (8, None, None, None, None, None, None, None, None, None),
    ]
    got = read_back(chat.canonical_turns(spark.createDataFrame(rows, kind), "id"))
    assert got[1][:3] == ("prompt_response", [("user", "p"), ("assistant", "r")], ["r"])
    assert got[2][0] == "system_prompt_response" and got[2][1][0] == ("system", "s")
    assert got[3][1] == [("user", "a"), ("assistant", "b\n"), ("", "")]
    assert got[4][:2] == ("from_value", [("user", "q"), ("assistant", "w")])
    assert got[5][:2] == ("instruction_input", [("user", "i"), ("user", "in"), ("assistant", "o")])
    assert got[6][0] == "instruction" and got[7][:2] == (None, []) and got[8][:2] == (None, [])


@pytest.mark.parametrize("text", ["", "<|end|>\n", "<|user|>\nx<|end|>\n", r"<\|end|>", r"<\\|", "</s>[INST] ok [/INST]", r"[\INST] <<s>> <\</s>", "a\\", "|>\n<|", "line\nline", "[[INST]]<<|>"])
def test_chat_round_trip(spark, text):
    rows = [(1, 0, text[:7], "q" + text), (1, 1, "assistant", text), (1, 2, None, None), (1, 3, "assistant", text + "z"), (None, 0, "user", "u")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = read_back(turn_records(df), "conv_id")
    assert got[1][1] == [(r or "", t or "") for c, _, r, t in rows if c]
    assert got[1][2] == [text, text + "z"] + ([] if text[:7] != "assistant" else ["q" + text])
    assert got[1][3].count("<|end|>\n") == 4 and "[INST]" not in got[1][3]


def test_chat_ties_and_empty(spark):
    df = spark.createDataFrame([(1, 1, "user", "b"), (1, 1, "user", "a"), (1, None, "user", "c"), (1, 1, "user", "a")], "conv_id long, turn long, role string, text string")
    got = read_back(turn_records(df), "conv_id")
    assert [t for _, t in got[1][1]] == ["c", "a", "a", "b"]
    assert chat.format_turns(turn_records(df.limit(0))).count() == 0


def test_chat_records_of_any_layout(spark):
    """One column holds records of many layouts; a null field is there, a missing one is not."""
    said = [
        {"prompt": "p", "response": None}, {"prompt": "p"}, {"messages": [{"role": "user", "content": "a"}, {"content": "b", "role": None}]}, {"messages": []},
        {"conversations": [{"from": "human", "value": 3}, {"from": "gpt", "value": "w"}]}, {"instruction": "i", "output": "o", "input": ""}, {"output": 1.5, "instruction": "i"}, {"text": "t", "role": "bot", "turn": 1}, [1, 2], "x",
    ]
    rows = [(i, json.dumps(x)) for i, x in enumerate(said)] + [(10, None), (None, json.dumps(said[0])), (7, json.dumps({"turn": 0, "role": None, "text": "u"}))]
    df = spark.createDataFrame(rows, "id int, said string").select("id", F.parse_json("said").alias("record"), F.lit("x").alias("pieces"), F.lit("x").alias("print"))
    got = read_back(chat.record_turns(df, "id"))
    assert got[0][:3] == ("prompt_response", [("user", "p"), ("assistant", "")], [""]) and got[None][:3] == got[0][:3]
    assert got[2][:2] == ("messages", [("user", "a"), ("", "b")])
    assert got[4][:2] == ("from_value", [("user", "3"), ("assistant", "w")])
    assert got[5][:2] == ("instruction_input", [("user", "i"), ("assistant", "o")]) and got[6][:2] == ("instruction", [("user", "i"), ("assistant", "1.5")])
    assert got[7][:2] == ("turn_rows", [("", "u"), ("bot", "t")])
    assert all(got[i][:2] == (None, []) for i in (1, 3, 8, 9, 10))
    shapes = df.select("id", chat.record_fingerprint(F.col("record")).alias("print")).filter("id = 2").first()["print"]
    assert shapes == hashlib.sha256(chat.record_shape(chat.LAYOUTS[1].paths).encode()).hexdigest()


def test_chat_long_and_hot(spark):
    """A conversation of many turns, one with a very long text; a column of the caller named like a helper stays."""
    rows = [(1, i, "assistant" if i % 2 else "user", f"<|end|>\n{i}") for i in range(3000)] + [(2, 0, "assistant", "<|x " * 200_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = read_back(turn_records(df), "conv_id")
    assert got[1][1] == [(r, t) for c, _, r, t in rows if c == 1] and got[2][2] == [rows[-1][3]]
    assert "pieces" in chat.format_turns(turn_records(df).withColumn("pieces", F.lit(1))).columns


# --- op3, op8 ----------------------------------------------------------------------------------


def hosted():
    common = "share this page with all of your friends now"
    rows = [(i, f"{prose(i, 60)}\n {common} \n{prose(i + 900, 20)}", "hot" if i % 3 else "cold") for i in range(60)]
    rows += [(100 + i, f"{common}\nshort", "hot") for i in range(5)]
    rows += [(200, "a b\n" * 40, "hot"), (201, prose(5, 40) + "\n" + prose(5, 40), None), (202, "w1 w2 w3 w4 w5 w6 w7 w8 w9 " * 30, None)]
    return rows + [(k, t, "odd") for k, t in ODD]


@pytest.mark.parametrize("extra", [False, True])
def test_line_rules(spark, docs_of, extra):
    rows = hosted()
    got = sorted(line_rules.judge(docs_of(rows, extra)).select("doc_id", *line_rules.MEASURES, "base_failed").collect(), key=str)
    want = []
    for k, t, _ in rows:
        m = ref.measures(t)
        want.append((k, *m, m[0] < 20 or 100 * m[4] > 30 * m[0]))
    assert [tuple(r) for r in got] == sorted(want, key=lambda r: str(tuple_row(got, r)))
    judged = {r["doc_id"]: r for r in line_rules.judge(docs_of(rows)).collect()}
    assert judged[31]["kept"] and judged[31]["n_removed_lines"] == 1 and "share this" not in judged[31]["cleaned"]
    assert not judged[100]["kept"] and not judged[202]["kept"]
    assert line_rules.judge(docs_of([])).count() == 0


def tuple_row(rows, values):
    return rows[0].__class__(**dict(zip(rows[0].__fields__, values)))


def test_depleted_documents_are_rejected(spark, docs_of):
    line = " ".join(f"common{i}" for i in range(40))
    rows = [(i, line + "\n" + (prose(i, 60) if i else "only five words are left")) for i in range(30)]
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in line_rules.judge(docs_of(rows)).collect()}
    assert got[0] == (False, False) and all(got[i] == (False, True) for i in range(1, 30))


@pytest.mark.parametrize("extra", [False, True])
def test_line_dedup(spark, docs_of, extra):
    rows = hosted()
    got = line_dedup.drop_boilerplate(docs_of(rows, extra))
    said = [(r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got.collect()]
    want = [(k, *x) for (k, _, _), x in zip(rows, ref.site_lines(rows, line_dedup.RATIO, line_dedup.LEAST_PAGES))]
    assert sorted(said, key=str) == sorted(want, key=str) and sum(w[3] for w in want) > 50
    assert line_dedup.drop_boilerplate(docs_of([])).count() == 0


def test_limits_hold_at_every_size(spark, docs_of):
    """A repeated passage in a large source and a boilerplate line on a host of six pages go; what pages share by chance stays."""
    passage = " ".join(f"passage{i}" for i in range(50))
    big = [(i, prose(i, 30) + ("\n" + passage if i < 6 else "") + ("\nseldom shared line" if i < 20 else ""), "big") for i in range(1200)]
    small = [(5000 + i, "All rights reserved here\n" + prose(9000 + i, 30), "small") for i in range(6)]
    for done, text in ((line_dedup.drop_boilerplate(docs_of(big + small)), "text"), (line_rules.judge(docs_of(big + small)), "cleaned")):
        got = {r["doc_id"]: r[text] for r in done.collect()}
        assert not any("passage1 " in x or "All rights" in x for x in got.values())
        assert all("seldom shared line" in got[i] for i in range(20))
        assert got[5000] == prose(9000, 30) and got[700] == prose(700, 30)


# --- op4 ---------------------------------------------------------------------------------------


def check_pieces(pieces, rows, end=1):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    want = sorted(tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, end]) for _, t in rows)
    fill = {}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == fill.get(p["sequence_id"], 0) and len(p["ids"]) == 4 * p["length"]
        fill[p["sequence_id"]] = p["offset"] + p["length"]
    return want, fill


def test_packing(spark, docs_of):
    rows = ODD + [(i, prose(i, 20 + 13 * i)) for i in range(100, 140)] + [(300, "it's we'll x.y., <|startoftext|>a. b<|endoftext|>, Σας ǅ İ ﬁ 12.5 !!.")]
    pieces = packing.pack(docs_of(rows, True), queries.tokenizer_path(), group_tokens=20_000).collect()
    want, fill = check_pieces(pieces, rows)
    assert max(fill.values()) <= 2048 and all(n & (n - 1) == 0 for n in fill.values())
    by = {}
    for p in sorted(pieces, key=lambda p: p["start"]):
        by.setdefault((p["doc_id"], p["doc_tokens"]), []).append(p)
    single = {k: v for k, v in by.items() if k[0] not in (4,)}
    for (_, tokens), parts in single.items():
        assert [p["start"] for p in parts] == list(np.cumsum([0] + [p["length"] for p in parts])[:-1]) and sum(p["length"] for p in parts) == tokens
    got = sorted(tuple(np.frombuffer(b"".join(bytes(p["ids"]) for p in parts), "<u4").tolist()) for parts in single.values())
    assert got == [w for w in want if w != want_of("one")] and len(by[4, len(want_of("one"))]) == 2
    assert packing.pack(docs_of([]), queries.tokenizer_path()).count() == 0


def want_of(text):
    from tokenizers import Tokenizer

    return tuple([*Tokenizer.from_file(queries.tokenizer_path()).encode(text, add_special_tokens=False).ids, 1])


def test_balance_is_even():
    lengths = np.random.default_rng(0).integers(1, 2048, 3000)
    placed = packing.balance(lengths, 2048, 1.0, 1 / 1024)
    room, cost = packing.rooms(int(lengths.sum()), 2048), {}
    for _, _, n, seq, _ in placed:
        cost[seq] = cost.get(seq, 0) + n + n * n / 1024
    full = [cost[i] for i in range(len(room)) if room[i] == 2048]
    assert sum(p[2] for p in placed) == room.sum() and len(placed) < len(lengths) + 1.2 * len(room)
    # whole documents of nearly 2048 tokens set the upper end; the rest is level
    assert np.percentile(full, 50) < 1.5 * np.mean(full)


# --- op5, op10 ---------------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    sf = SF.replace("0.001", "0.1")
    got = queries.op5_toxicity_ftrl(spark, sf).toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    both = got.merge(labels, on="doc_id")
    both = both[both["held_out"]]
    assert got["score"].between(0, 1).all() and (got["held_out"] == got["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    rank = both["score"].rank()
    pos = both["toxic"] == 1
    auc = (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
    assert auc > 0.95 and (both["predicted"] == both["toxic"]).mean() > 0.96


def test_toxicity_edges(spark, docs_of):
    labels = spark.createDataFrame([(1, 1), (None, 1), (4, None), (7, 0)], "doc_id long, toxic int")
    docs = docs_of(ODD, True)
    scores = toxicity.score(docs, toxicity.train(docs, labels)).toPandas()
    assert len(scores) == len(ODD) and scores["score"].between(0, 1).all()
    assert toxicity.score(docs_of([]), toxicity.train(docs_of([]), labels)).count() == 0


def test_weak_labels_find_junk(spark):
    sf = SF.replace("0.001", "0.01")
    got = queries.op10_quality_classifier(spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    good, bad = got[got["quality"] == 1], got[got["quality"] == 0]
    assert good["kept"].mean() > 0.99 and (~bad["kept"]).mean() > 0.8


def test_estimate_recovers_accuracies():
    rng = np.random.default_rng(2)
    truth = rng.random(20_000) < 0.7
    accuracy = np.array([0.95, 0.9, 0.8, 0.7, 0.6])
    votes = np.where(rng.random((len(truth), 5)) < accuracy, truth[:, None], ~truth[:, None]).astype(int)
    votes[rng.random(votes.shape) < 0.3] = 2
    seen, count = np.unique(votes, axis=0, return_counts=True)
    posterior = quality.estimate([(bytes(v.tolist()), int(c)) for v, c in zip(seen, count)])
    said = np.array([posterior[bytes(v.tolist())] > 0.5 for v in votes])
    plain = (votes == 1).sum(1) >= (votes == 0).sum(1)
    assert (said == truth).mean() > 0.92 and (said == truth).mean() >= (plain == truth).mean()


def test_quality_edges(spark, docs_of):
    docs = docs_of(ODD + [(40, prose(3, 200)), (41, "### $$$ ||| &&& " * 40)], True)
    got = quality.classify(docs)
    assert got.count() == len(ODD) + 2 and set(docs.columns) <= set(got.columns)
    assert quality.classify(docs_of([])).count() == 0


# --- op6, op7 ----------------------------------------------------------------------------------

LICENSED = [
    (30, "Released under the MIT License."), (31, "THE mit license and MIT License mit license"), (32, "this work is licensed under the GNU General Public License, version 3!"),
    (33, "Licensed under CC BY-NC 4.0."), (34, "Permission is hereby granted, free of charge, to any fine person obtaining a copy of this software and the associated documentation files (the Software), to deal in the Software without restriction"),
    (35, "apache license " * 2000), (36, "mİt license K"),
]


@pytest.mark.parametrize("extra", [False, True])
def test_licenses(spark, docs_of, extra):
    rows = ODD + LICENSED
    got = licenses.scan(docs_of(rows, extra)).collect()
    want = []
    for k, t in rows:
        at = ref.phrases(t)
        want.append((k, len(ref.alnum(t)), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at}))))
    assert sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got), key=str) == sorted(want, key=str)
    labels = {r["doc_id"]: (r["labels"], r["score"]) for r in got}
    assert labels[33] == ("cc-by-nc", 1.0) and labels[34][0] == "mit" and labels[7] == ("", 0.0) and labels[1] == ("", 0.0)
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in got)
    assert licenses.scan(docs_of([])).count() == 0


def test_license_long_text(spark, docs_of):
    """One very long text: the grams leave it without the whole text beside each, so twice the words is about twice the work."""
    notice = " Released under the MIT License. "
    text = "some other words of no licence at all " * 20_000 + notice + "under the " * 20_000 + "licensed under cc by nc 4 0"
    (r,) = licenses.scan(docs_of([(1, text)])).collect()
    at = len(ref.alnum(text.split(notice)[0]))
    assert (r["n_base"], r["first_word"], r["labels"]) == (1, at + 3, "cc-by-nc,mit")
    assert sorted((s["label"], s["first"]) for s in r["spans"]) == [("cc-by-nc", r["n_words"] - 7), ("mit", at)]
    plan = licenses.scan(docs_of([(1, text)]))._jdf.queryExecution().optimizedPlan().toString()
    assert "said" not in next(line for line in plan.splitlines() if "Generate" in line).split("[", 1)[1].split("]", 1)[0]


def test_winnowing_guarantee():
    rng = np.random.default_rng(4)
    for n in (13, 14, 40, 200):
        shared = rng.integers(0, 5, n).astype(np.uint64)
        a = np.concatenate([rng.integers(0, 5, 30).astype(np.uint64), shared, rng.integers(0, 5, 9).astype(np.uint64)])
        mine, theirs = decontaminate.rolling(a, 8), decontaminate.rolling(shared, 8)
        inside = {int(mine[i]) for i in decontaminate.winnow(mine) if 30 <= i <= 30 + n - 8}
        assert inside & {int(theirs[i]) for i in decontaminate.winnow(theirs)}


@pytest.mark.parametrize("extra", [False, True])
def test_decontamination(spark, docs_of, extra):
    long = prose(50, 80).split()
    items = [(1, " ".join(long[:40])), (2, " ".join(long[20:60])), (3, "Short item of five words"), (4, "one"), (5, None), (6, "..."), (7, "a a a a a a a a a a a a a a a"), (None, " ".join(long[60:78])), (2, " ".join(long[20:60]))]
    rows = ODD + [
        (50, prose(60, 100) + " " + " ".join(long[:13]).upper() + " " + prose(61, 100)), (51, " ".join(long[:12])), (52, " ".join(long)), (53, "x short ITEM, of five words y " + prose(62, 300)),
        (54, "a " * 500), (55, prose(63, 3000) + " ".join(long[5:30])), (56, " ".join(long[58:]) + " one"), (57, " ".join(long[:15] + long[16:35])),
    ]
    found = ref.windows(items)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.verdicts(decontaminate.hits(docs_of(rows, extra), benchmark)).collect()
    said = [(r["key"], r["n_words"], r["n_hit"], len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r["contaminated"]) for r in got]
    want = [(k, *ref.contamination(t, found)) for k, t in rows]
    assert sorted(said, key=str) == sorted(want, key=str)
    clean = decontaminate.clean(docs_of(rows, extra), benchmark)
    assert sorted(map(str, (r["doc_id"] for r in clean.collect()))) == sorted(str(w[0]) for w in want if not w[5])
    assert decontaminate.clean(docs_of([]), benchmark).count() == 0
    assert decontaminate.clean(docs_of(rows), benchmark.limit(0)).count() == len(rows)


# --- op9 ---------------------------------------------------------------------------------------


def copies():
    """Groups of edited copies around the threshold, one larger than the rest, with a common passage."""
    rng = random.Random(8)
    rows, common = [], " ".join(prose(70, 25).split())
    for group, size, length, edits in ((0, 40, 60, 4), (1, 25, 80, 5), (2, 3, 12, 1), (3, 2, 400, 20), (4, 12, 30, 2), (5, 6, 5, 1)):
        base = prose(700 + group, length).split()
        for _ in range(size):
            said = list(base)
            for _ in range(rng.randint(0, edits)):
                said[rng.randrange(len(said))] = rng.choice(WORDS) + "x"
            rows.append((1000 + len(rows), " ".join(said)))
    rows += [(2000 + i, prose(800 + i, 30) + " " + common) for i in range(40)]
    rows += [(3000, rows[0][1].upper()), (3001, rows[0][1]), (1000, rows[0][1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("block", "many"), [(ngram_join.BLOCK, ngram_join.MANY), (200, 0)])
def test_ngram_join(spark, docs_of, block, many, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "MANY", many)
    monkeypatch.setattr(ngram_join, "ROUNDS", 4 if many else 1)
    rows = ODD + copies()
    got = ngram_join.join(docs_of(rows, block != 200)).select("key", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == sorted(((k, *x) for (k, _), x in zip(rows, ref.near(rows))), key=str)


def test_drop_duplicates(spark, docs_of):
    rows = ODD + copies()
    kept = [(r["doc_id"], r["text"]) for r in ngram_join.drop_duplicates(docs_of(rows, extra=True)).collect()]
    near = ref.near(rows)
    groups = {c for (k, t), (n, c) in zip(rows, near) if n}
    with_words = [k for k, t in kept if ref.spaced(t)]
    assert len(with_words) == len(groups) and set(with_words) == groups
    assert sum(not ref.spaced(t) for _, t in kept) == sum(not ref.spaced(t) for _, t in rows)
    assert ngram_join.drop_duplicates(docs_of([])).count() == 0
    assert ngram_join.join(docs_of([(1, None), (2, "")])).count() == 2


def test_prefix_theorem():
    """Sets above the threshold always share what the first prefixes demand."""
    rng = np.random.default_rng(6)
    for _ in range(300):
        n = int(rng.integers(1, 120))
        base = rng.choice(10_000, n, replace=False)
        other = np.unique(np.concatenate([rng.choice(base, max(1, n - int(rng.integers(0, n // 4 + 1))), replace=False), rng.choice(10_000, int(rng.integers(0, n // 4 + 1)))]))
        base = np.sort(base)
        both = len(np.intersect1d(base, other))
        if 100 * both >= 75 * (len(base) + len(other) - both):
            shared = len(np.intersect1d(base[: ngram_join.first_prefix(len(base))], other[: ngram_join.first_prefix(len(other))]))
            for size in (len(base), len(other)):
                assert shared >= max(1, int(np.ceil(0.1 * np.ceil(size * 0.75))))


# --- registered queries against SQL ------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = normal(queries.QUERIES[name](spark, SF).toPandas()), normal(duck.execute(queries.ORACLES[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want) and got.equals(want)


def test_names():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 11))
