"""The registered queries of the numbered operators and the SQL that states their results."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spreadlake.llm import chat, decontaminate, hard_negatives, hosts, licenses, line_dedup, line_rules, merkle, ngram_join, packing, pii, quality, toxicity, wrappers
from spreadlake.llm.common import table

#: Where the public tokenizer's file lies; a parameter of the packing operator.
TOKENIZER = "word_bpe_49k.json"
#: What the two turns of the control conversation say.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pii_skip_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole document."""
    return pii.find(table(spark, sf_dir, "documents"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation and conversation -7, formatted and read back.

    The table's rows are records of one turn each; conversation -7 comes as one
    record with a list of messages.  The fingerprint of each record selects its mapping.
    """
    rows = table(spark, sf_dir, "conversations")
    records = rows.select("conv_id", F.to_variant_object(F.struct("turn", "role", "text")).alias("record"))
    said = json.dumps({"messages": [{"role": role, "content": CONTROL_TEXT} for role in ("user", "assistant")]})
    control = spark.range(1, numPartitions=1).select(F.lit(-7).cast(rows.schema["conv_id"].dataType).alias("conv_id"), F.parse_json(F.lit(said)).alias("record"))
    turns = chat.record_turns(records.unionByName(control), "conv_id")
    return chat_digest(chat.format_turns(turns), "conv_id")


def chat_digest(done: DataFrame, id_col: str) -> DataFrame:
    read = done.select(id_col, "formatted", chat.read_turns(F.col("formatted")).alias("read"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("learned"))
    said = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join("learned", "")
    return read.select(
        id_col,
        F.size("read").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_SAFE = r"""regexp_replace({x}, '([<\[])(\\*)(\||s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)', '\1\\\2\3', 'g')"""
OP2_SQL = f"""WITH every_turn AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{CONTROL_TEXT}' UNION ALL SELECT -7, 1, 'assistant', '{CONTROL_TEXT}'),
 sized AS (SELECT *, length({_SAFE.format(x="role")}) + length({_SAFE.format(x="text")}) + 13 AS chars FROM every_turn)
 SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars FROM sized GROUP BY conv_id"""


def op4_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity; the fold ``held_out`` is never learnt from."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id",
        F.coalesce(~toxicity.in_training_fold("doc_id"), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op3_line_frequency_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    return line_rules.judge(table(spark, sf_dir, "documents")).select("doc_id", *line_rules.MEASURES, "base_failed", "kept", "n_removed_lines")


_WHITE = r"[\x20\x09-\x0D]"
_BARE = "regexp_replace({x}, '^" + _WHITE + "+|" + _WHITE + "+$', '', 'g')"
_NORMAL = _BARE.format(x="regexp_replace(regexp_replace(lower({x}), '[0-9]+', '0', 'g'), '" + _WHITE + "+', ' ', 'g')")
OP3_SQL = f"""WITH docs AS (SELECT doc_id, source, text, list_filter(regexp_split_to_array(coalesce(text, ''), '{_WHITE}+'), lambda w: w <> '') AS words,
  string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
 placed AS (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM docs WHERE len(words) >= 8),
 windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(words[i : i + 7], ' ')) AS times FROM placed),
 repeats AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM windows WHERE times > 1) GROUP BY doc_id),
 keyed AS (SELECT doc_id, source, unnest(list_distinct(list_transform(lines, lambda x: {_NORMAL.format(x="x")}))) AS line FROM docs),
 totals AS (SELECT source, count(*) AS total FROM docs GROUP BY source),
 common AS (SELECT k.source, k.line FROM keyed k JOIN totals t ON k.source IS NOT DISTINCT FROM t.source WHERE k.line <> ''
  GROUP BY k.source, k.line, t.total HAVING count(*) >= {line_rules.LEAST_DOCS} AND count(*) > CAST(CASE WHEN length(k.line) >= {hosts.LONG} THEN {line_rules.LONG_LIMIT} ELSE {line_rules.LIMIT} END AS DOUBLE) * t.total),
 each_line AS (SELECT doc_id, source, unnest(lines) AS line FROM docs),
 kept AS (SELECT e.doc_id, count(c.line) AS removed, coalesce(sum(len(list_filter(regexp_split_to_array(e.line, '{_WHITE}+'), lambda w: w <> ''))) FILTER (c.line IS NULL), 0) AS left_words
  FROM each_line e LEFT JOIN common c ON c.source IS NOT DISTINCT FROM e.source AND c.line = {_NORMAL.format(x="e.line")} GROUP BY e.doc_id),
 told AS (SELECT d.doc_id, len(words) AS n_words, len(array_to_string(words, '')) AS word_chars, len(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
  len(list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
  coalesce(r.n, 0) AS n_repeat_words, k.removed, k.left_words FROM docs d LEFT JOIN repeats r USING (doc_id) JOIN kept k USING (doc_id)),
 failed AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM told)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (removed > 0 AND (left_words < {line_rules.LEFT_WORDS} OR left_words < {line_rules.LEFT_SHARE} * n_words)) AS kept, removed AS n_removed_lines FROM failed"""


def op6_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License labels of every document."""
    return licenses.scan(table(spark, sf_dir, "documents")).drop("spans")


_UPPER, _LOWER = licenses.UPPER, licenses.LOWER
_ALNUM = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), '" + _UPPER + "', '" + _LOWER + r"'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
_TEMPLATES = ", ".join(f"({i}, '{label}', string_split('{said}', ' '))" for i, (label, said) in enumerate(licenses.TEMPLATES))
_PHRASES = ", ".join(f"('{label}', {len(said)}, '{' '.join(said)}')" for label, said in licenses.PHRASES.items())
OP6_SQL = f"""WITH docs AS (SELECT doc_id, {_ALNUM} AS words FROM documents), phrases(label, n, said) AS (VALUES {_PHRASES}), templates(template, label, words) AS (VALUES {_TEMPLATES}),
 word_at AS (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM docs),
 places AS (SELECT doc_id, i - 1 AS place, label FROM word_at JOIN phrases ON array_to_string(words[i : i + n - 1], ' ') = said),
 base AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS labels FROM places GROUP BY doc_id),
 tg AS (SELECT template, label, len(words) AS size, i - 1 AS tpos, array_to_string(words[i : i + 2], ' ') AS gram FROM (SELECT *, unnest(range(1, len(words) - 1)) AS i FROM templates)),
 hits AS (SELECT doc_id, template, label, size, i - 1 - tpos AS diagonal, i - 1 AS dpos, tpos FROM word_at JOIN tg ON i + 2 <= len(words) AND array_to_string(words[i : i + 2], ' ') = gram),
 voted AS (SELECT doc_id, template, label, size, diagonal, list(DISTINCT tpos) AS placed FROM hits GROUP BY ALL),
 opened AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) <= {licenses.SLACK} THEN 0 ELSE 1 END AS opens FROM voted),
 runs AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS run FROM opened),
 covering AS (SELECT doc_id, template, label, size, run, unnest(range(t, t + 3)) AS word FROM (SELECT *, unnest(placed) AS t FROM runs)),
 spans AS (SELECT doc_id, label, count(DISTINCT word) / size AS covered FROM covering GROUP BY doc_id, template, label, size, run HAVING count(DISTINCT word) / size >= {licenses.COVERED}),
 extra AS (SELECT doc_id, list(DISTINCT label) AS labels, max(covered) AS best FROM spans GROUP BY doc_id)
 SELECT d.doc_id, len(d.words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(b.labels, e.labels))), ','), '') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0) END AS score
  FROM docs d LEFT JOIN base b USING (doc_id) LEFT JOIN extra e USING (doc_id)"""
OP7_SQL = f"""WITH docs AS (SELECT doc_id, {_ALNUM} AS words FROM documents), items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ALNUM} AS words FROM benchmark),
 sized AS (SELECT item, words, least({decontaminate.SPAN}, len(words)) AS n FROM items WHERE len(words) > 0),
 theirs AS (SELECT DISTINCT item, n, array_to_string(words[i : i + n - 1], ' ') AS said FROM (SELECT *, unnest(range(1, len(words) - n + 2)) AS i FROM sized)),
 sizes AS (SELECT DISTINCT n FROM theirs),
 ours AS (SELECT doc_id, i, n, array_to_string(words[i : i + n - 1], ' ') AS said FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM docs, sizes WHERE len(words) >= n)),
 hits AS (SELECT doc_id, i, n, item FROM ours JOIN theirs USING (n, said)),
 covered AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS word FROM hits) GROUP BY doc_id),
 named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS said FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
 SELECT d.doc_id, len(d.words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(said, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.words) AS contaminated FROM docs d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)"""


def op7_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words inside windows of benchmark items."""
    found = decontaminate.verdicts(decontaminate.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    return found.select(
        F.col("key").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op8_site_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the boilerplate lines of its source."""
    return line_dedup.drop_boilerplate(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


OP8_SQL = f"""WITH docs AS (SELECT doc_id, source, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
 keyed AS (SELECT doc_id, source, unnest(list_distinct(list_transform(lines, lambda x: {_BARE.format(x="x")}))) AS line FROM docs),
 totals AS (SELECT source, count(*) AS total FROM docs GROUP BY source),
 common AS (SELECT k.source, k.line FROM keyed k JOIN totals t ON k.source IS NOT DISTINCT FROM t.source WHERE k.line <> ''
  GROUP BY k.source, k.line, t.total HAVING count(*) >= {line_dedup.LEAST_PAGES} AND count(*) > CAST(CASE WHEN length(k.line) >= {hosts.LONG} THEN {line_dedup.LONG_RATIO} ELSE {line_dedup.RATIO} END AS DOUBLE) * t.total),
 each_line AS (SELECT doc_id, source, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM docs),
 marked AS (SELECT e.doc_id, e.i, e.line, c.line IS NOT NULL AS dropped FROM each_line e
  LEFT JOIN common c ON c.source IS NOT DISTINCT FROM e.source AND c.line = {_BARE.format(x="e.line")}),
 done AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '') AS cleaned, count(*) AS n, count(*) FILTER (dropped) AS gone FROM marked GROUP BY doc_id)
 SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN x.cleaned END AS text, CASE WHEN d.text IS NULL THEN 0 ELSE x.n END AS n_lines,
  CASE WHEN d.text IS NULL THEN 0 ELSE x.gone END AS n_dropped FROM docs d JOIN done x USING (doc_id)"""


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's set size and component of near duplicates."""
    return ngram_join.join(table(spark, sf_dir, "documents")).select(F.col("key").alias("doc_id"), "n_shingles", "component_id")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weak votes, posterior, score and verdict of every document."""
    return quality.classify(table(spark, sf_dir, "documents")).select("doc_id", "weak_votes", "weak_good", "quality_score", "kept")


def op11_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's article."""
    return wrappers.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


#: For pages whose article is one ``article`` element without a frame inside, and these references.
OP11_SQL = r"""WITH inner_html AS (SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '(?is)<article(?:\s[^>]*)?>(.*?)</article>', 1), '<br\s*/?>', ' ', 'gi') AS said FROM pages),
 blocks AS (SELECT *, list_transform(regexp_split_to_array(said, '</?(?:p|h[1-6]|div|ul|ol|li|blockquote|pre|section|table|tr|td|th)(?:\s[^>]*)?>'), lambda x: regexp_replace(x, '<[^>]*>', '', 'g')) AS pieces FROM inner_html),
 decoded AS (SELECT *, list_transform(pieces, lambda x: trim(regexp_replace(regexp_replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS lines FROM blocks),
 told AS (SELECT page_id, url, array_to_string(list_filter(lines, lambda x: x <> ''), chr(10)) AS text FROM decoded)
 SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM told"""


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, proof and verdict."""
    return merkle.verify(table(spark, sf_dir, "documents"))


def _merkle_sql(levels: int) -> str:
    """Levels over levels: children of a run in order, and each leaf's way up.  Holds for up to 8 ** levels leaves a language."""
    said = lambda x: f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen(CAST({x} AS VARCHAR)) || ':' || {x} END"
    leaf = lambda text: f"sha256({' || '.join(said(c) for c in ('doc_id', 'source', 'lang', 'n_chars'))} || {said(text)})"
    lower = f"translate(text, '{_UPPER}', '{_LOWER}')"
    parts = [
        f"""seen AS MATERIALIZED (SELECT doc_id, lang, {leaf("text")} AS leaf, CASE WHEN crc % 3 = 0 THEN {leaf(lower)} ELSE {leaf("text")} END AS now FROM (SELECT *, {_crc32_sql("CAST(doc_id AS VARCHAR)")} AS crc FROM documents))""",
        "way0 AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r, '' AS proof, now AS node FROM seen)",
        "lev0 AS (SELECT lang, r, leaf AS d, count(*) OVER (PARTITION BY lang) AS n FROM way0)",
    ]
    step = "array_to_string(c[1 : w.r % 8], '') || {x} || array_to_string(c[w.r % 8 + 2 : 8], '')"
    for i in range(levels):
        parts.append(f"run{i} AS MATERIALIZED (SELECT lang, r // 8 AS r, list(d ORDER BY r) AS c, max(n) AS n FROM lev{i} GROUP BY lang, r // 8)")
        parts.append(f"lev{i + 1} AS (SELECT lang, r, CASE WHEN n > 1 THEN sha256(array_to_string(c, '')) ELSE c[1] END AS d, (n + 7) // 8 AS n FROM run{i})")
        parts.append(
            f"way{i + 1} AS MATERIALIZED (SELECT w.doc_id, w.lang, w.leaf, w.r // 8 AS r, CASE WHEN n > 1 THEN w.proof || {step.format(x=chr(39) * 2)} ELSE w.proof END AS proof,"
            f" CASE WHEN n > 1 THEN sha256({step.format(x='w.node')}) ELSE w.node END AS node FROM way{i} w JOIN run{i} x ON x.lang IS NOT DISTINCT FROM w.lang AND x.r = w.r // 8)"
        )
    last = f"lev{levels}"
    parts += [
        f"tops AS (SELECT lang, d AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS p FROM {last})",
        "own AS (SELECT list(subroot ORDER BY p) AS c, count(*) AS n FROM tops)",
    ]
    up = "CASE WHEN n > 1 THEN sha256({inner}) ELSE {alone} END"
    return (
        f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM (SELECT w.doc_id, w.leaf, t.subroot,"
        f" {up.format(inner='array_to_string(c, %s)' % repr(''), alone='t.subroot')} AS root, sha256(w.proof || CASE WHEN n > 1 THEN array_to_string(c[1 : p], '') || array_to_string(c[p + 2 :], '') ELSE '' END) AS proof_sha256,"
        f" {up.format(inner='array_to_string(c[1 : p], %s) || w.node || array_to_string(c[p + 2 :], %s)' % (repr(''), repr('')), alone='w.node')} AS folded_root"
        f" FROM way{levels} w JOIN tops t ON t.lang IS NOT DISTINCT FROM w.lang, own)"
    )


def _crc32_sql(said: str) -> str:
    """The checksum of ASCII text, bit by bit; DuckDB has no such function."""
    byte = f"list_transform(string_split({said}, ''), lambda x: CAST(ascii(x) AS BIGINT))"
    shift = "list_reduce(list_concat([xor(c, b)], range(8)), lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)"
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {byte}), lambda c, b: {shift}), 4294967295)"


#: As many levels as 2,097,152 documents of one language and 8 languages need.
OP12_SQL = _merkle_sql(7)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of each anchor and positive."""
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"))


OP13_SQL = """WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT a.id AS anchor, a.label = c.label AS same, c.id, CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score FROM v a JOIN v c ON a.id <> c.id WHERE a.id % 100 = 0),
 pos AS (SELECT anchor, id AS positive, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) AS r FROM s WHERE same) WHERE r <= 5),
 neg AS (SELECT p.*, s.id, s.score, row_number() OVER (PARTITION BY p.anchor, p.positive ORDER BY s.score DESC, s.id) AS r FROM pos p JOIN s ON s.anchor = p.anchor AND NOT s.same
  AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score)
 SELECT anchor AS anchor_id, positive AS positive_id, CAST(r AS INT) AS rank, id AS negative_id, positive_score, score AS negative_score FROM neg WHERE r <= 5"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii_skip_chain": op1_pii_skip_chain,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_line_frequency_rules": op3_line_frequency_rules,
    "op4_cost_balanced_packing": op4_cost_balanced_packing,
    "op5_toxicity_ftrl": op5_toxicity_ftrl,
    "op6_license_diagonals": op6_license_diagonals,
    "op7_winnowing_decontamination": op7_winnowing_decontamination,
    "op8_site_line_frequency": op8_site_line_frequency,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_html_wrappers": op11_html_wrappers,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_hard_negatives": op13_hard_negatives,
}
ORACLES: dict[str, str] = {"op2_chat_formatting": OP2_SQL, "op3_line_frequency_rules": OP3_SQL, "op6_license_diagonals": OP6_SQL, "op7_winnowing_decontamination": OP7_SQL, "op8_site_line_frequency": OP8_SQL, "op11_html_wrappers": OP11_SQL, "op12_merkle_manifest": OP12_SQL, "op13_hard_negatives": OP13_SQL}
