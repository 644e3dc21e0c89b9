"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set is its distinct 5-word shingles, as 64-bit hashes; documents
with equal sets are one class.  With ``o = ceil(0.75 n)``, two linked sets share
at least ``o`` shingles, so in any common order their first ``n - o + l``
shingles share at least ``l``: a prefix lengthened by ``l - 1`` demands ``l``
shared shingles.  The join uses this twice.

1. *Which classes can have a partner.*  In hash order, every class offers a
   prefix lengthened by a tenth of its size, and stays if enough of it is found
   in other classes too.  Common lines and passages don't carry a class over
   this bar; copies do.
2. *Candidates.*  Among those left, all shingles are counted.  Classes with too
   many shingles of their own go.  The others order theirs from rare to
   frequent, and lengthen the prefix by the estimated cost of its candidates
   (the postings behind it).

Groups of near copies are not expanded into pairs.  Each class is first verified
against one pivot, the class of smallest hash among those of a shared prefix
shingle, and links merge into components; that repeats while it pays.  What is
left are buckets of a prefix shingle that hold several components.  Small ones
list their pairs, and those that share enough prefix shingles are verified; large
ones are compared as a whole, in blocks of bounded size.
No link between different components is lost, and links inside one don't
matter.  All counts are exact for all documents; no bucket is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from spreadlake.llm.common import fresh, scratch, staged, text_bytes, words_of

SHINGLE = 5
PERCENT = 75
#: The first prefix is longer by this share of the set.
LONGER = 0.1
#: Postings a task gathers before it deals them out, and shingles in a block of the verification.
GATHERED, BLOCK = 500_000, 200_000
#: Pairs of classes up to which a bucket's are listed; larger buckets are compared in blocks.
MANY = 1024
#: Bits of the bitmaps of texts that stay after step 1 and of classes to verify (4 MB); more entries only make them less sharp.
BITS = 25
#: Bits of a set's sketch of odd counts (16 longs).
ODD_BITS = 1024
#: Further pivot rounds while one links at least this share of what it tried.
PAYS, ROUNDS = 0.02, 4

_ODD = np.random.default_rng(5).integers(1, 2**63, SHINGLE + 1, dtype=np.uint64) | np.uint64(1)


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of a whole text's shingles; fewer than five words make one; no words none."""
    words = words_of(text)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if not len(h):
        return h
    size = min(SHINGLE, len(h))
    n = len(h) - size + 1
    out = h[:n] * _ODD[0]
    for k in range(1, size):
        out ^= out >> np.uint64(29)
        out *= _ODD[k]
        out += h[k : n + k]
    out = (out ^ (out >> np.uint64(32))) * _ODD[SHINGLE] + np.uint64(size)
    return np.unique(out ^ (out >> np.uint64(29)))


def owner_of(found: np.ndarray) -> int:
    """Name of a set: a positive 63-bit hash of its shingles."""
    return max(1, xxhash.xxh3_64_intdigest(found.tobytes()) >> 1)


def odd_sketch(found: np.ndarray) -> np.ndarray:
    """Which of ``ODD_BITS`` hash values an odd number of a set's shingles has; each shingle that only one of two sets holds changes one bit."""
    odd = np.bincount(found.astype(np.uint64) & np.uint64(ODD_BITS - 1), minlength=ODD_BITS) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<i8")


def least_overlap(n):
    """Shingles that a linked partner shares at least: ``ceil(PERCENT n / 100)``."""
    return -(-PERCENT * n // 100)


def first_prefix(n: int) -> int:
    return min(n, n - least_overlap(n) + max(1, int(np.ceil(LONGER * n))))


def first_bar(n: np.ndarray) -> np.ndarray:
    """Shared shingles that a class needs in its first prefix: those its smallest possible partner's prefix demands."""
    return np.maximum(1, np.ceil(LONGER * least_overlap(n)))


# --- postings dealt by shingle ------------------------------------------------------------------

DEALT = "bucket int, low binary, high binary, owners binary"
_DEALT = [("bucket", pa.int32()), ("low", pa.binary()), ("high", pa.binary()), ("owners", pa.binary())]


class Dealer:
    """Postings (shingle, owner) packed by bucket: 6 bytes of the shingle below its bucket's bits, 8 of the owner."""

    def __init__(self, bits: int):
        self.bits = bits
        self.tokens: list[np.ndarray] = []
        self.owners: list[int] = []
        self.held = 0

    def add(self, tokens: np.ndarray, owner: int) -> None:
        self.tokens.append(tokens)
        self.owners.append(owner)
        self.held += len(tokens)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        tokens = np.concatenate(self.tokens) if self.tokens else np.zeros(0, np.uint64)
        owners = np.repeat(np.array(self.owners, np.int64), [len(t) for t in self.tokens])
        self.tokens, self.owners, self.held = [], [], 0
        return tokens, owners

    def packed(self, tokens: np.ndarray, owners: np.ndarray) -> Iterator[tuple[int, bytes, bytes, bytes]]:
        order = np.argsort(tokens)
        tokens, owners = tokens[order], owners[order]
        bucket = (tokens >> np.uint64(64 - self.bits)).astype(np.int64)
        rest = (tokens << np.uint64(self.bits)) >> np.uint64(16)
        low, high = (rest & np.uint64(0xFFFFFFFF)).astype("<u4"), (rest >> np.uint64(32)).astype("<u2")
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(tokens)], strict=True):
            if b > a:
                yield int(bucket[a]), low[a:b].tobytes(), high[a:b].tobytes(), owners[a:b].tobytes()


def unpacked(batch: pa.RecordBatch, rows: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles cut to ``bits + 48`` bits, owners) of the packed rows."""
    column = {name: batch.column(name).take(pa.array(rows)).to_pylist() for name, _ in _DEALT}
    tokens, owners = [], []
    for bucket, low, high, own in zip(*column.values(), strict=True):
        t = np.frombuffer(low, "<u4").astype(np.uint64) | np.frombuffer(high, "<u2").astype(np.uint64) << np.uint64(32)
        tokens.append((np.uint64(bucket) << np.uint64(64 - bits)) | (t << np.uint64(16)) >> np.uint64(bits))
        owners.append(np.frombuffer(own, np.int64))
    empty = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    return np.concatenate(tokens or empty[0]), np.concatenate(owners or empty[1])


def groups(tokens: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (shingle, owner) by shingle, and the number of owners of each one's shingle."""
    order = np.lexsort((owners, tokens))
    tokens, owners = tokens[order], owners[order]
    new = np.ones(len(tokens), bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (owners[1:] != owners[:-1])
    tokens, owners = tokens[new], owners[new]
    first = np.ones(len(tokens), bool)
    first[1:] = tokens[1:] != tokens[:-1]
    at = np.flatnonzero(first)
    size = np.diff(np.append(at, len(tokens)))
    return tokens, owners, np.repeat(size, size)


def bucket_bits(df: DataFrame) -> int:
    """At least 8 buckets per shuffle partition, so that hashed buckets fill partitions evenly."""
    return max(10, (8 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))).bit_length())


def dealt(df: DataFrame) -> DataFrame:
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "bucket")


def owner_buckets(df: DataFrame) -> int:
    return 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def by_owner(owners: np.ndarray, n: int, *columns: np.ndarray) -> Iterator[tuple]:
    """(owner's bucket, owners, columns) as bytes, one row per bucket: a task's rows grow with the partitions only."""
    bucket = owners % n
    order = np.lexsort((owners, bucket))  # an owner's entries side by side, which compresses well
    bucket, owners, columns = bucket[order], owners[order], [c[order] for c in columns]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(owners)], strict=True):
        if b > a:
            yield int(bucket[a]), owners[a:b].tobytes(), *[c[a:b].tobytes() for c in columns]


def joined_bytes(batches: list[pa.RecordBatch], name: str, dtype: str) -> np.ndarray:
    parts = [np.frombuffer(x, dtype) for b in batches for x in b.column(name).to_pylist() if x is not None]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def plain_rows(batches: list[pa.RecordBatch], *names: str) -> list[np.ndarray]:
    """Columns of the rows that are not packed (their first column is not null)."""
    out = []
    for name in names:
        parts = [b.column(name).filter(b.column(names[0]).is_valid()).to_numpy(zero_copy_only=False) for b in batches]
        out.append(np.concatenate(parts) if parts else np.zeros(0, np.int64))
    return out


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A batch of the given columns; the others are null."""
    n = len(next(iter(columns.values())))
    made = {name: x.cast(schema.field(name).type) if isinstance(x, pa.Array) else pa.array(x, schema.field(name).type) for name, x in columns.items()}
    return pa.RecordBatch.from_arrays([made[f.name] if f.name in made else pa.nulls(n, f.type) for f in schema], schema=schema)


def bitmap_of(hashes: DataFrame) -> Broadcast:
    """A bitmap of the low ``BITS`` bits of a column of hashes, in 64-bit words."""
    bit = hashes.select(F.pmod(F.col(hashes.columns[0]), F.lit(1 << BITS)).alias("bit"))
    words = bit.groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("set")).toPandas()
    table = np.zeros(1 << (BITS - 6), np.int64)
    table[words["at"].to_numpy(np.int64)] = words["set"].to_numpy(np.int64)
    return hashes.sparkSession.sparkContext.broadcast(table)


def in_bitmap(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bit = hashes & ((1 << BITS) - 1)
    return (table[bit >> 6] >> (bit & 63) & 1).astype(bool)


def pruned(rows: DataFrame, owners: DataFrame) -> DataFrame:
    """Rows whose ``owner`` may be among the owners: none of those is lost, and few others come along.

    Before a join that shuffles the rows: whole sets are the widest rows there are.
    """
    return in_bitmap_only(rows, bitmap_of(owners))


def in_bitmap_only(rows: DataFrame, bitmap: Broadcast) -> DataFrame:
    @F.pandas_udf("boolean")
    def wanted(owner: pd.Series) -> pd.Series:
        return pd.Series(in_bitmap(bitmap.value, owner.to_numpy()))

    return rows.filter(wanted("owner"))


# --- step 1: which classes can have a partner ---------------------------------------------------

#: In place of an owner: the shingle has several owners in one task, which has counted them.
SEVERAL = 0


def survey(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Staged: rows (key, mark, n, owner) of all documents, and packed rows (home, owners, times) of counts of shared shingles.

    ``owner`` is the hash of the set, ``mark`` that of the text.  A shingle that
    several classes of one task hold is counted there and posted once, so a
    shingle in a third of all documents makes a posting per task.  A class is
    posted once per task however many copies it has.
    """
    kind = docs.schema[id_col].dataType
    schema = pa.schema([("key", to_arrow_type(kind)), ("mark", pa.int64()), ("n", pa.int64()), ("owner", pa.int64()), ("home", pa.int64()), ("times", pa.binary()), *_DEALT])
    ddl = f"key {kind.simpleString()}, mark bigint, n bigint, owner bigint, home bigint, times binary, {DEALT}"
    homes = owner_buckets(docs)
    raw = docs.select(F.col(f"`{id_col}`").alias("key"), text_bytes(f"`{text_col}`").alias("raw")).withColumn("mark", F.xxhash64("raw"))
    bits = bucket_bits(docs)

    def counted(out: pa.Schema, own: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
        home, owners, times = zip(*by_owner(own, homes, times.astype(np.int64)), strict=True)
        return batch_of(out, home=home, owners=owners, times=times, **({"bucket": np.array(home, np.int32)} if "bucket" in out.names else {}))

    def post(dealer: Dealer) -> Iterator[pa.RecordBatch]:
        tokens, owners, size = groups(*dealer.take())
        alone = size == 1
        own, count = np.unique(owners[~alone], return_counts=True)
        if len(own):
            yield counted(schema, own, count)
        several = np.unique(tokens[~alone])
        packed = list(dealer.packed(np.concatenate([tokens[alone], several]), np.concatenate([owners[alone], np.full(len(several), SEVERAL, np.int64)])))
        if packed:
            yield batch_of(schema, **dict(zip([n for n, _ in _DEALT], zip(*packed, strict=True), strict=True)))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer, met = Dealer(bits), set()
        for batch in batches:
            n, owner = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for i, text in enumerate(batch.column("raw")):
                found = shingles(text.as_py())
                n[i] = len(found)
                owner[i] = owner_of(found)
                if len(found) and owner[i] not in met:
                    met.add(int(owner[i]))
                    dealer.add(found[: first_prefix(len(found))], int(owner[i]))
                    if dealer.held >= GATHERED:
                        yield from post(dealer)
            yield batch_of(schema, key=batch.column("key"), mark=batch.column("mark"), n=n, owner=owner, bucket=(owner & 0x3FFFFFFF).astype(np.int32))
        yield from post(dealer)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, owners = [], []
        for batch in batches:
            posted = batch.column("low").is_valid().to_numpy(zero_copy_only=False)
            if not posted.all():
                yield batch.filter(pa.array(~posted)).select(out.names)
            if posted.any():
                t, o = unpacked(batch, np.flatnonzero(posted), bits)
                tokens.append(t)
                owners.append(o)
        if tokens:
            _, own, size = groups(np.concatenate(tokens), np.concatenate(owners))
            # several owners, or one besides those counted elsewhere
            own, times = np.unique(own[(size > 1) & (own != SEVERAL)], return_counts=True)
            if len(own):
                yield counted(out, own, times)

    out = pa.schema([schema.field(name) for name in ("key", "mark", "n", "owner", "home", "owners", "times")])
    return staged(dealt(raw.mapInArrow(look, ddl)).mapInArrow(count, f"key {kind.simpleString()}, mark bigint, n bigint, owner bigint, home bigint, owners binary, times binary"))


def surviving(docs: DataFrame, seen: DataFrame, text_col: str) -> DataFrame:
    """Staged: ``owner, n, odd, tokens`` of the classes that pass the first bar, each once."""
    homes = owner_buckets(docs)
    class_rows = seen.filter("n > 0").groupBy("owner").agg(F.max("n").alias("n"), F.min("mark").alias("mark")).select(F.pmod("owner", F.lit(homes)).alias("home"), "owner", "n", "mark")
    both = class_rows.unionByName(seen.filter(F.col("home").isNotNull()).select("home", "owners", "times"), allowMissingColumns=True)
    picked = pa.schema([("n", pa.int64()), ("mark", pa.int64())])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        owner, n, mark = plain_rows(held, "owner", "n", "mark")
        names, at = np.unique(joined_bytes(held, "owners", "<i8"), return_inverse=True)
        if not len(owner) or not len(names):
            return
        total = np.bincount(at, weights=joined_bytes(held, "times", "<i8"))
        place = np.minimum(np.searchsorted(names, owner), len(names) - 1)
        stays = (names[place] == owner) & (total[place] >= first_bar(n))
        yield batch_of(picked, n=n[stays], mark=mark[stays])

    marks = staged(both.repartition(homes // 4, "home").mapInArrow(pick, "n bigint, mark bigint"))
    bitmap = bitmap_of(marks.select("mark"))
    schema = pa.schema([("owner", pa.int64()), ("n", pa.int64()), ("odd", pa.list_(pa.int64())), ("tokens", pa.list_(pa.int64()))])

    def sets_of(owners: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        return batch_of(schema, owner=owners, n=[len(s) for s in sets], odd=[odd_sketch(s) for s in sets], tokens=sets)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, met = bitmap.value, set()
        for batch in batches:
            owners, sets, held = [], [], 0
            for i in np.flatnonzero(in_bitmap(known, batch.column("mark").to_numpy())):
                found = shingles(batch.column("raw")[int(i)].as_py())
                owner = owner_of(found)
                if not len(found) or owner in met:
                    continue
                met.add(owner)
                owners.append(owner)
                sets.append(found.view(np.int64))
                held += len(found)
                if held >= GATHERED:
                    yield sets_of(owners, sets)
                    owners, sets, held = [], [], 0
            if owners:
                yield sets_of(owners, sets)

    raw = docs.select(text_bytes(f"`{text_col}`").alias("raw")).withColumn("mark", F.xxhash64("raw"))
    return staged(raw.mapInArrow(look, "owner bigint, n bigint, odd array<bigint>, tokens array<bigint>").dropDuplicates(["owner"]))


# --- step 2: prefixes by frequency --------------------------------------------------------------


def prefixes(sets: DataFrame) -> DataFrame:
    """Staged: ``owner, n, need, prefix`` of the classes that can still have a partner.

    ``need`` is how many prefix shingles a pair must share, the smaller of the two.
    """
    bits = bucket_bits(sets)
    packed_schema = pa.schema(_DEALT)
    part_schema = pa.schema([("home", pa.int64()), ("owners", pa.binary()), ("part", pa.binary()), ("times", pa.binary())])
    homes = owner_buckets(sets)
    out_schema = pa.schema([("owner", pa.int64()), ("n", pa.int64()), ("need", pa.int32()), ("prefix", pa.list_(pa.int64()))])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = Dealer(bits)

        def post() -> pa.RecordBatch:
            return batch_of(packed_schema, **dict(zip([n for n, _ in _DEALT], zip(*dealer.packed(*dealer.take()), strict=True), strict=True)))

        for batch in batches:
            values, at = batch.column("tokens").flatten().to_numpy().view(np.uint64), 0
            for owner, n in zip(batch.column("owner").to_pylist(), batch.column("n").to_pylist(), strict=True):
                dealer.add(values[at : at + n], owner)
                at += n
                if dealer.held >= GATHERED:
                    yield post()
        if dealer.held:
            yield post()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [unpacked(b, np.arange(b.num_rows), bits) for b in batches]
        if not parts:
            return
        tokens, owners, size = groups(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        shared = size > 1
        tokens, owners, size = tokens[shared], owners[shared], size[shared]
        rows = list(by_owner(owners, homes, tokens.view(np.int64), np.minimum(size, 2**31 - 1).astype(np.int32)))
        if rows:
            yield batch_of(part_schema, **dict(zip(part_schema.names, zip(*rows, strict=True), strict=True)))

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        names, sizes = plain_rows(held, "owner", "n")
        owners, tokens, times = joined_bytes(held, "owners", "<i8"), joined_bytes(held, "part", "<i8"), joined_bytes(held, "times", "<i4")
        by = np.lexsort((tokens, times, owners))  # of each owner, rare shingles first
        owners, tokens, times = owners[by], tokens[by], times[by]
        first, last = np.searchsorted(owners, names, "left"), np.searchsorted(owners, names, "right")
        rows = []
        for owner, n, a, b in zip(names.tolist(), sizes.tolist(), first.tolist(), last.tolist(), strict=True):
            alone, most = n - (b - a), n - least_overlap(n)
            if alone > most:
                continue
            shortest = most + 1 - alone
            cost = int((times[a : a + shortest] - 1).sum())
            need = min(1 + (cost // 8).bit_length(), b - a - shortest + 1)
            rows.append((owner, n, need, tokens[a : a + shortest + need - 1]))
        if rows:
            yield batch_of(out_schema, **dict(zip(out_schema.names, zip(*rows, strict=True), strict=True)))

    counted = dealt(sets.select("owner", "n", "tokens").mapInArrow(deal, DEALT)).mapInArrow(count, "home bigint, owners binary, part binary, times binary")
    both = sets.select(F.pmod("owner", F.lit(homes)).alias("home"), "owner", "n").unionByName(counted, allowMissingColumns=True)
    return staged(both.repartition(homes // 4, "home").mapInArrow(order, "owner bigint, n bigint, need int, prefix array<bigint>"))


# --- links and components -----------------------------------------------------------------------


def is_link(shared: Column, n: Column, m: Column) -> Column:
    return 100 * shared >= PERCENT * (n + m - shared)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b`` of the pairs whose sets are similar enough.

    Only sets of able pairs are shuffled: by their sizes, and by their sketches,
    which differ in no more bits than shingles are in one of the two sets only.
    """
    size = lambda name: sets.select(F.col("owner").alias(name), F.col("n").alias(f"n_{name}"), F.col("odd").alias(f"odd_{name}"))
    differ = F.aggregate(F.zip_with("odd_a", "odd_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, bits: total + bits)
    most = F.least(F.col("n_a"), F.col("n_b"), (F.col("n_a") + F.col("n_b") - differ) / 2)
    able = is_link(most, F.col("n_a"), F.col("n_b"))
    tried = staged(pairs.join(size("a"), "a").join(size("b"), "b").filter(able).drop("odd_a", "odd_b"))
    whole = lambda name: pruned(sets, tried.select(name)).select(F.col("owner").alias(name), F.col("tokens").alias(f"s_{name}"))
    shared = F.size(F.array_intersect("s_a", "s_b"))
    return tried.join(whole("a"), "a").join(whole("b"), "b").filter(is_link(shared, F.col("n_a"), F.col("n_b"))).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node reachable, by least labels and pointer jumping; staged each round."""
    a, b = F.col("a"), F.col("b")
    ends = F.explode(F.array(*[F.struct(x.alias("a"), y.alias("b")) for x, y in ((a, b), (b, a), (a, a), (b, b))])).alias("end")
    both = staged(edges.select(ends).select("end.*").distinct())  # each node is its own neighbour too
    labels = staged(both.groupBy(a.alias("node")).agg(F.min("b").alias("root")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b")
        lower = near.groupBy(a.alias("node")).agg(F.max(F.when(a == b, F.col("root"))).alias("was"), F.min("root").alias("root"))
        jump = lower.select(F.col("node").alias("root"), F.col("root").alias("next"))
        moved = staged(lower.join(jump, "root", "left").select("node", "was", F.least("root", F.coalesce("next", "root")).alias("root")))
        labels = moved.select("node", "root")
        if moved.filter(F.col("was") != F.col("root")).isEmpty():
            return labels


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``owner, comp`` after the links: components of the components that they join."""
    with scratch(links.sparkSession) as keep:
        return keep(_merged(labels, links))


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    ends = links.join(labels.select(F.col("owner").alias("a"), F.col("comp").alias("x")), "a").join(labels.select(F.col("owner").alias("b"), F.col("comp").alias("y")), "b")
    roots = components(ends.filter(F.col("x") != F.col("y")).select(F.col("x").alias("a"), F.col("y").alias("b")))
    found = labels.join(roots.select(F.col("node").alias("comp"), "root"), "comp", "left")
    return staged(found.select("owner", F.coalesce("root", "comp").alias("comp")))


def pivots(held: DataFrame, turn: int) -> DataFrame:
    """For each class the pivot of other components with which it shares most prefix shingles: ``a, b``."""
    rank = F.struct(F.xxhash64("owner", F.lit(turn)).alias("h"), "owner", "comp")
    best = held.groupBy("token").agg(F.min(rank).alias("pivot"))
    met = held.join(best, "token").filter(F.col("comp") != F.col("pivot.comp")).groupBy("owner", F.col("pivot.owner").alias("pivot")).agg(F.count(F.lit(1)).alias("times"))
    return met.groupBy("owner").agg(F.max(F.struct("times", "pivot")).alias("best")).select(F.col("owner").alias("a"), F.col("best.pivot").alias("b"))


def rest_links(held: DataFrame, labels: DataFrame, core: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between components, enough to join all that any link joins.

    Linked classes share a shingle of their shortest prefixes.  Where the bucket
    of a shingle holds at most ``MANY`` pairs of classes of different components,
    the pairs are listed, each once, and those that share enough prefix shingles
    (those in larger buckets count as shared) are verified.  Larger buckets are
    compared as they are, not as pairs.
    """
    each = held.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("c"))
    pairs_in = each.groupBy("token").agg(((F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))) / 2).alias("pairs")).filter("pairs > 0")
    kinds = staged(pairs_in.select("token", (F.col("pairs") > MANY).alias("large")))
    any_large = not kinds.filter("large").isEmpty()
    listed = held.join(kinds.filter("NOT large").select("token"), "token").select("token", "owner", "comp")
    met = listed.alias("x").join(listed.alias("y"), "token").filter("x.owner < y.owner AND x.comp <> y.comp")
    met = met.groupBy(F.col("x.owner").alias("a"), F.col("y.owner").alias("b")).agg(F.count(F.lit(1)).alias("times"))
    bar = core.select("owner", "need", F.lit(0).alias("more"))
    if any_large:
        in_large = held.join(kinds.filter("large").select("token"), "token").groupBy("owner").agg(F.count(F.lit(1)).alias("more"))
        bar = core.select("owner", "need").join(in_large, "owner", "left").select("owner", "need", F.coalesce("more", F.lit(0)).alias("more"))
    of = lambda name: bar.select(F.col("owner").alias(name), F.col("need").alias(f"need_{name}"), F.col("more").alias(f"more_{name}"))
    enough = met.join(of("a"), "a").join(of("b"), "b").filter(F.col("times") + F.least("more_a", "more_b") >= F.least("need_a", "need_b")).select("a", "b")
    if not any_large:
        return verified(enough, sets)
    large = held.filter("shortest").join(kinds.filter("large").select("token"), "token").select("token", "owner")
    return verified(enough, sets).union(block_links(large, labels, core, sets))


def block_links(held: DataFrame, labels: DataFrame, core: DataFrame, sets: DataFrame) -> DataFrame:
    """Links inside large buckets (token, owner), enough to join the components that any of them joins.

    Of buckets with the same classes one is taken.  A bucket is cut into parts
    of about ``BLOCK`` shingles, and each pair of parts is a block that one task
    holds.
    """
    sized = held.join(core.select("owner", "n"), "owner")
    hashed = lambda salt: F.sum(F.shiftright(F.xxhash64("owner", F.lit(salt)), 24))
    buckets = sized.groupBy("token").agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("rows"), hashed(1).alias("h1"), hashed(2).alias("h2"))
    distinct = buckets.groupBy("rows", "size", "h1", "h2").agg(F.min("token").alias("token"))
    plan = staged(distinct.select("token", F.ceil(F.col("size") / BLOCK).alias("parts")))
    members = held.join(plan, "token").select("token", "owner", F.pmod(F.xxhash64("owner"), F.col("parts")).alias("part"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    placed = staged(members.select("token", "owner", F.least("part", "other").alias("row"), F.greatest("part", "other").alias("col"), "part"))
    bitmap = bitmap_of(placed.select("owner"))
    here = lambda rows: in_bitmap_only(rows, bitmap)
    whole = here(labels).join(here(core.select("owner", "need", "prefix")), "owner").join(here(sets.select("owner", "tokens")), "owner")
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in blocks(batches):
            found = block_pairs(rows)
            if found:
                yield batch_of(out, a=[f[0] for f in found], b=[f[1] for f in found])

    n = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt_out = placed.join(whole, "owner").select("token", "row", "col", "part", "comp", "owner", "need", "prefix", "tokens")
    return dealt_out.repartition(n, "token", "row", "col").sortWithinPartitions("token", "row", "col").mapInArrow(compare, "a bigint, b bigint")


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows (part, component, owner, need, prefix, tokens) of each block of a sorted partition."""
    at, rows = None, []
    for batch in batches:
        names = zip(*(batch.column(c).to_pylist() for c in ("token", "row", "col", "part", "comp", "owner", "need")), strict=True)
        for (*block, part, comp, owner, need), prefix, tokens in zip(names, batch.column("prefix"), batch.column("tokens"), strict=True):
            if block != at:
                if rows:
                    yield rows
                at, rows = block, []
            rows.append((part, comp, owner, need, prefix.values.to_numpy(), tokens.values.to_numpy()))
    if rows:
        yield rows


class Inverted:
    """Shingles of several sets in order, to count what a set shares with each of them."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = len(sets)
        tokens, whose = np.concatenate(sets), np.repeat(np.arange(self.n), [len(s) for s in sets])
        order = np.argsort(tokens, kind="stable")
        self.tokens, self.whose = tokens[order], whose[order]

    def shared(self, mine: np.ndarray) -> np.ndarray:
        low, high = np.searchsorted(self.tokens, mine, "left"), np.searchsorted(self.tokens, mine, "right")
        count = high - low
        at = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(int(count.sum()))
        return np.bincount(self.whose[at], minlength=self.n)


def block_pairs(rows: list[tuple]) -> list[tuple[int, int]]:
    """Links that join the components of a block wherever any link does.

    Within one part all classes meet, between two parts those of different
    parts.  The most frequent component's classes are only met by the others.
    Pairs must share as many prefix shingles as they demand before their sets
    are counted.
    """
    comps = np.array([r[1] for r in rows])
    names, local, times = np.unique(comps, return_inverse=True, return_counts=True)
    if len(names) < 2:
        return []
    part, need, size = (np.array(x) for x in ([r[0] for r in rows], [r[3] for r in rows], [len(r[5]) for r in rows]))
    two_parts = part.min() != part.max()
    prefixes_, whole = Inverted([r[4] for r in rows]), Inverted([r[5] for r in rows])
    joined = np.arange(len(names))  # the components as they merge
    out, largest = [], int(times.argmax())
    for i, row in enumerate(rows):
        if local[i] == largest:
            continue
        apart = joined[local] != joined[local[i]]
        if two_parts:
            apart &= part != part[i]
        if not apart.any():
            continue
        able = apart & (prefixes_.shared(row[4]) >= np.minimum(need, need[i]))
        if not able.any():
            continue
        shared = whole.shared(row[5])
        for j in np.flatnonzero(able & (100 * shared >= PERCENT * (size + size[i] - shared))):
            mine, other = joined[local[i]], joined[local[j]]
            if other != mine:
                joined[joined == other] = mine
                out.append((row[2], rows[int(j)][2]))
    return out


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``key`` (its id), ``mark`` (its text's hash), ``n_shingles``, ``group``, ``component_id``.

    ``component_id`` is the smallest id reachable by links, itself included;
    rows with one ``group`` are one component.  Null or wordless texts have an
    empty set and are linked with nothing: ``group`` is null and
    ``component_id`` their own id.  Repeated rows are linked as equal sets.  A
    null id never is the smallest, unless its whole component has none; then
    ``component_id`` is null.  An empty table gives no rows.
    """
    seen = survey(docs, id_col, text_col)
    sets = surviving(docs, seen, text_col)
    core = prefixes(sets)
    at = core.select("owner", F.posexplode("prefix").alias("at", "token"), (F.size("prefix") - F.col("need")).alias("last"))
    posted = staged(at.select("owner", "token", (F.col("at") <= F.col("last")).alias("shortest")))
    # at first each class is a component of its own
    labels, held = core.select("owner", F.col("owner").alias("comp")), posted.withColumn("comp", F.col("owner"))
    for turn in range(ROUNDS):
        tried = staged(pivots(held, turn))
        links = staged(verified(tried, sets))
        both = tried.select(F.lit(False).alias("link")).union(links.select(F.lit(True).alias("link")))
        n_tried, n_links = both.agg(F.count_if(~F.col("link")), F.count_if(F.col("link"))).first()
        if n_links:
            labels = merged(labels, links)
            held = posted.join(labels, "owner")
        if n_links <= PAYS * n_tried:
            break
    links = staged(rest_links(held, labels, core, sets))
    if not links.isEmpty():
        labels = merged(labels, links)
    every = seen.filter(F.col("n").isNotNull()).select("key", "mark", "n", "owner")
    # a class without links is its own component
    named = every.filter("n > 0").join(labels.select("owner", "comp"), "owner", "left").select("key", "mark", "n", F.coalesce("comp", "owner").alias("group"))
    smallest = named.groupBy("group").agg(F.min("key").alias("component_id"))
    linked = named.join(smallest, "group").select("key", "mark", F.col("n").alias("n_shingles"), "group", "component_id")
    alone = every.filter("n = 0").select("key", "mark", F.col("n").alias("n_shingles"), F.lit(None).cast("bigint").alias("group"), F.col("key").alias("component_id"))
    return linked.unionByName(alone)


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id, then of the smallest text hash.

    A null id comes last.  Rows without words are linked with nothing and stay.
    Of rows that repeat both id and text one stays.
    """
    with scratch(docs.sparkSession) as keep:
        found = keep(staged(join(docs, id_col, text_col).filter(F.col("group").isNotNull()).select("key", "mark", "group")))
    rank = F.struct(F.col("key").isNull().alias("none"), "key", "mark")
    first = found.groupBy("group").agg(F.min(rank).alias("first"))
    ranked = found.join(first, "group").withColumn("stays", F.col("key").eqNullSafe(F.col("first.key")) & (F.col("mark") == F.col("first.mark")))
    key, told = fresh(docs, "gone_key"), fresh(docs, "gone_mark")
    gone = staged(ranked.filter(~F.col("stays")).select(F.col("key").alias(key), F.col("mark").alias(told)).distinct())
    mark = F.xxhash64(text_bytes(f"`{text_col}`"))
    same = lambda key, m: F.col(f"`{id_col}`").eqNullSafe(F.col(key)) & (mark == F.col(m))
    kept = docs.join(gone, same(key, told), "left_anti")
    twice = staged(ranked.filter("stays").groupBy(F.col("key").alias(key), F.col("mark").alias(told)).count().filter("count > 1").drop("count"))
    if twice.isEmpty():
        return kept
    once = kept.join(twice, same(key, told), "left_semi").dropDuplicates([id_col, text_col])
    return kept.join(twice, same(key, told), "left_anti").unionByName(once)
