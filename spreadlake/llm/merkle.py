"""Merkle manifest of a table as a content-addressed graph, with proofs by descent.

Rows are leaves of one tree per group (language); the groups' roots are leaves
of a tree of their own.  Every inner node is a record ``digest -> children``,
stored once whatever it stands for.  Proofs come from the records alone: the
requests of all leaves start at the root, and at each level the digits of a
leaf's rank say which child to go to, while the children that are not selected
join the path.  Requests that share their digits so far travel as one row, so a
level moves one row per node, not per leaf.  A path is collected from the root
down and reversed at the end.

Every step is a join or an aggregation on (tree, run) or a digest; there is no
window over a group, and the driver sees four numbers and the root.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spreadlake.llm.common import staged
from spreadlake.llm.licenses import lowered

#: Children of a node.
FAN = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_BITS, _ROW_BITS = 3, 33  # 8 = 2**3; monotonically_increasing_id keeps the partition above 33 bits of row number


def field(value: Column) -> Column:
    """A value with its UTF-8 byte count, so that no two rows give the same input; null is ``-``."""
    said = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said), F.lit("-"))


def digest(*inputs: Column) -> Column:
    return F.sha2(F.concat(*inputs), 256)


def height(n: Column) -> Column:
    """Levels above ``n`` leaves: the smallest h with FAN**h >= n."""
    return F.size(F.filter(F.sequence(F.lit(0), F.lit(20)), lambda h: F.pow(F.lit(float(FAN)), h) < n))


def _levels(n: int) -> int:
    h = 0
    while FAN**h < n:
        h += 1
    return h


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``rank`` (from 0) inside ``tree`` and the tree's number of rows ``n``.

    Rows are range-partitioned and sorted, so a tree of any size is many tasks;
    a row's rank is its place in its partition plus the counts of earlier ones.
    Rows that are equal in all of ``order`` are spread by a number of their own.
    """
    spread = F.rand(7)
    laid = rows.repartitionByRange("tree", *order, spread).sortWithinPartitions("tree", *order)
    placed = staged(laid.withColumn("at", F.monotonically_increasing_id()).withColumn("chunk", F.shiftright("at", _ROW_BITS)))
    counted = placed.groupBy("tree", "chunk").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("held"))
    earlier = Window.partitionBy("tree").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = counted.withColumn("base", F.coalesce(F.sum("held").over(earlier), F.lit(0)) - F.col("first")).withColumn("n", F.sum("held").over(Window.partitionBy("tree")))
    known = staged(base.select("tree", "chunk", "base", "n"))
    return placed.join(known, ["tree", "chunk"]).withColumn("rank", F.col("at") + F.col("base")).drop("at", "chunk", "base")


def grow(level: DataFrame, most: int) -> tuple[list[DataFrame], DataFrame]:
    """All levels above ``level`` (tree, rank, digest, n, with n > 1 and at most ``most``).

    Returns the records of each level and the trees' roots (tree, digest).
    """
    records, tops = [], []
    while most > 1:
        runs = level.groupBy("tree", F.shiftright("rank", _BITS).alias("run")).agg(F.array_sort(F.collect_list(F.struct("rank", "digest"))).alias("kids"), F.max("n").alias("n"))
        up = runs.select("tree", F.col("run").alias("rank"), F.col("kids.digest").alias("children"), F.ceil(F.col("n") / FAN).alias("n"))
        up = staged(up.withColumn("digest", digest(F.array_join("children", ""))))
        records.append(up.select("digest", "children"))
        tops.append(up.filter("n = 1").select("tree", "digest"))
        level, most = up.filter("n > 1").select("tree", "rank", "digest", "n"), -(-most // FAN)
    return records, _union(tops)


def _union(parts: list[DataFrame]) -> DataFrame | None:
    whole = None
    for part in parts:
        whole = part if whole is None else whole.unionByName(part)
    return whole


@dataclass
class Manifest:
    """The records of a table: ``runs`` of leaves, ``records`` of inner nodes, ``trees`` with their roots, the root."""

    runs: DataFrame  # tree, run, members(rank, leaf, carried)
    records: DataFrame  # digest, children
    trees: DataFrame  # tree, place, n, digest
    root: str | None
    n_trees: int
    most: int


def manifest(leaves: DataFrame, order: list[str], carried: list[str]) -> Manifest:
    """Build all levels over ``leaves`` (``tree``, ``leaf`` and the columns ``order`` and ``carried``).

    Trees are ordered by ``tree``, leaves by ``order`` and then by their digest,
    nulls first; equal leaves keep a place each.
    """
    lined = ranked(leaves, [*order, "leaf"])
    member = F.struct("rank", "leaf", *[c for c in carried])
    grouped = lined.groupBy("tree", F.shiftright("rank", _BITS).alias("run")).agg(F.array_sort(F.collect_list(member)).alias("members"), F.max("n").alias("n"))
    runs = staged(grouped)
    sizes = runs.filter("run = 0").select("tree", "n")
    n_trees, most = sizes.agg(F.count(F.lit(1)), F.coalesce(F.max("n"), F.lit(0))).first()
    first = runs.select("tree", F.col("run").alias("rank"), F.col("members.leaf").alias("children"), F.ceil(F.col("n") / FAN).alias("n"), F.col("n").alias("rows"))
    first = first.withColumn("digest", F.when(F.col("rows") > 1, digest(F.array_join("children", ""))).otherwise(F.element_at("children", 1)))
    above, tops = grow(first.filter("n > 1").select("tree", "rank", "digest", "n"), -(-most // FAN))
    roots = _union([first.filter("n = 1").select("tree", "digest"), *([tops] if tops is not None else [])])
    trees = staged(ranked(roots.withColumn("name", F.col("tree")).withColumn("tree", F.lit(0)), ["name"]).select(F.col("name").alias("tree"), F.col("rank").alias("place"), "digest").join(sizes, "tree"))
    over, top = grow(trees.select(F.lit(0).alias("tree"), F.col("place").alias("rank"), "digest", F.lit(n_trees).cast("long").alias("n")), n_trees)
    root = (top if top is not None else trees.select("digest")).select("digest").first()
    records = _union([first.filter("rows > 1").select("digest", "children"), *above, *over]).dropDuplicates(["digest"])
    return Manifest(runs, staged(records), trees, root[0] if root else None, n_trees, most)


def _descend(requests: DataFrame, records: DataFrame) -> DataFrame:
    """One level down: a request with levels left asks for its node's children and goes to each of them."""
    found = records.withColumnRenamed("digest", "asked")
    asked = requests.withColumn("asked", F.when(F.col("left") > 0, F.col("digest"))).join(found, "asked", "left").drop("asked")
    stay = F.array(F.col("digest"))
    down = asked.select("*", F.posexplode(F.coalesce("children", stay)).alias("digit", "child"))
    others = F.concat(F.slice("children", 1, F.col("digit")), F.slice("children", F.col("digit") + 2, FAN))
    moved = F.col("left") > 0
    segment = F.struct(F.col("digit").alias("digit"), others.alias("siblings"))
    return down.select(
        *[c for c in requests.columns if c not in ("digest", "path", "place", "left")],
        F.col("child").alias("digest"),
        F.when(moved, F.col("place") * FAN + F.col("digit")).otherwise(F.col("place")).alias("place"),
        F.when(moved, F.col("left") - 1).otherwise(F.lit(0)).alias("left"),
        F.when(moved, F.array_append("path", segment)).otherwise(F.col("path")).alias("path"),
    )


def proofs(m: Manifest) -> DataFrame:
    """One row per leaf: ``tree``, ``subroot``, the member's columns and ``path``, segments (digit, siblings) from the leaf up."""
    spark = m.records.sparkSession
    if m.root is None:
        start = spark.range(0).select(F.lit("").alias("digest"))
    else:
        start = spark.range(1).select(F.lit(m.root).alias("digest"))
    empty = F.array().cast("array<struct<digit:int,siblings:array<string>>>")
    up = _levels(m.n_trees)
    requests = start.select("digest", F.lit(0).cast("long").alias("place"), F.lit(up).alias("left"), empty.alias("path"))
    for _ in range(up):
        requests = _descend(requests, m.records)
    # at the roots of trees: the place says which; runs of leaves are the last inner level
    inner = F.greatest(height(F.col("n")) - 1, F.lit(0))
    entered = requests.select("place", "path").join(m.trees, "place")
    requests = entered.select("tree", F.col("digest").alias("subroot"), "n", "digest", F.lit(0).cast("long").alias("place"), inner.alias("left"), "path")
    for _ in range(max(0, _levels(m.most) - 1)):
        requests = staged(_descend(requests, m.records))
    # the last step goes to the leaves; a lone leaf is its tree's root and has no run above it
    asked = requests.withColumn("asked", F.when(F.col("n") > 1, F.col("digest"))).join(m.records.withColumnRenamed("digest", "asked"), "asked", "left")
    last = asked.select("tree", F.col("place").alias("run"), "subroot", "path", "children").join(m.runs.select("tree", "run", F.explode("members").alias("member")), ["tree", "run"])
    digit = F.pmod(F.col("member.rank"), F.lit(FAN)).cast("int")
    siblings = F.concat(F.slice("children", F.lit(1), digit), F.slice("children", digit + 2, F.lit(FAN)))
    whole = F.when(F.col("children").isNull(), F.col("path")).otherwise(F.array_append("path", F.struct(digit.alias("digit"), siblings.alias("siblings"))))
    return last.select("tree", "subroot", "member.*", F.reverse(whole).alias("path"))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    joined = lambda parts: F.array_join(parts, "")
    step = lambda node, s: digest(joined(F.slice(s["siblings"], F.lit(1), s["digit"])), node, joined(F.slice(s["siblings"], s["digit"] + 1, F.lit(FAN))))
    return F.aggregate(path, leaf, step)


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.flatten(F.transform(path, lambda s: s["siblings"])), ""), 256)


def leaf_of(columns: tuple[str, ...] = FIELDS, **changed: Column) -> Column:
    return digest(*[field(changed.get(c, F.col(f"`{c}`"))) for c in columns])


def verify(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row of ``docs``.

    ``tampered`` marks rows whose text has its A-Z lower-cased after the manifest
    was made (by default those whose id's checksum is divisible by 3; null marks
    nothing); ``folded_root`` is what the row as it is now and its original
    proof give.

    A null field is an input of its own (``-``), unlike an empty one.  A null
    language is a tree and comes first, as does a null id in its tree.  Repeated
    rows are leaves of their own, side by side; rows of one id are ordered by
    their digest.  A text of any length is hashed inside one expression.  Other
    columns are not part of a leaf and may have any name.  An empty table gives
    no rows.
    """
    mark = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0 if tampered is None else tampered, F.lit(False))
    now = F.when(mark, leaf_of(text=lowered(F.col("text").cast("string")))).otherwise(F.lit(None))
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("-"))  # '-' sorts before '='
    leaves = docs.select("doc_id", tree.alias("tree"), leaf_of().alias("leaf"), now.alias("now"))
    m = manifest(leaves, ["doc_id"], ["doc_id", "now"])
    done = proofs(m).select(
        "doc_id", "leaf", "subroot", F.lit(m.root).cast("string").alias("root"), proof_digest(F.col("path")).alias("proof_sha256"), fold(F.coalesce("now", "leaf"), F.col("path")).alias("folded_root")
    )
    return done.withColumn("verified", F.col("folded_root") == F.col("root"))
