"""Mixing sources to target weights, with DataFrame functions only.

Documents are packed, source by source, into blocks of a fixed number of tokens: a document covers the tokens
[offset, offset + size) of its source, so block numbers are arithmetic on a prefix sum. Targets are filled like
water: each source gets its weight's share, none more than max_repeat times its size, and what that frees goes to
the others by weight. The source counts of the output shards are drawn: each of a source's slots (as many as its
target asks for) falls into a shard of its own, by a hash of source and slot, so a source's counts over the shards
are multinomial, and those of a shard are multinomial given the sources' totals, which stay at their targets. The
counts decide the slots: a shard's slots of a source are numbered on from those of the shards before it. Slot numbers
go through a pseudorandom permutation of the source's block numbers (swap-or-not, one for each source and pass), and
blocks are joined by number, so a document's shards are those that drew its blocks (first_shard is the least).

Prefix sums run in two levels, over buckets of a source and within a bucket, so a source that holds a third of all
rows is spread over many tasks. Rows without doc_id are dealt to buckets by size; those of one size are alike, so the
files that they are read from may number them.

Defined results: null or empty text has size 0 and is never taken; a null source is a source of its own, last in
order; repeated rows are separate documents; a null doc_id is kept; ties (one doc_id, one size) take neighbouring
places in any order. Texts of any length are counted whole. Other columns are ignored, whatever their names. An empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, shuffle_partitions

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
BLOCK_TOKENS = 256
SHARD_TOKENS = 1 << 20
MAX_REPEAT = 3
#: Buckets of a source, and shards of a group, for the two-level prefix sums.
BUCKETS = 1021
SHARD_GROUP = 1024
SEED = 20240
ROUNDS = 16
_PRIME = 2147483647
_SLOT_CHUNK = 4096


def _round_key(rank: Column, epoch: Column, r: Column) -> Column:
    """A number under 2^31 for each source, pass and round."""
    x = ((rank * 48271 + epoch * 69621 + r * 16807 + 12345) % _PRIME) * 1103515245 % _PRIME
    return (x * 950706376 + 7) % _PRIME


def permuted(x: Column, n: Column, rank: Column, epoch: Column, inverse: bool = False) -> Column:
    """x under a pseudorandom permutation of 0 .. n - 1 (swap-or-not), or under its inverse."""

    def turn(at: Column, r: Column) -> Column:
        key = _round_key(rank, epoch, r)
        other = F.pmod(key * 1000003 - at, n)
        top = F.greatest(at, other)
        bit = F.shiftright((((top % _PRIME) * 742938285 + key) % _PRIME) * 1226874159 % _PRIME, 11) % 2
        return F.when(bit == 1, other).otherwise(at)

    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if inverse else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(F.transform(rounds, lambda r: r.cast("long")), x.cast("long"), turn)


def _mixed(x: Column) -> Column:
    """A 32-bit finaliser of x < 2^32."""
    for _ in range(2):
        x = F.shiftright(x, 16).bitwiseXOR(x) * 0x45D9F3B
        x = x.bitwiseAND(0xFFFFFFFF)
    return F.shiftright(x, 16).bitwiseXOR(x)


def source_key(rank: Column) -> Column:
    return _mixed((rank + SEED).bitwiseAND(0xFFFFFFFF))


def slot_key(source: Column, slot: Column) -> Column:
    """A number for the slots of a source that agree but for their last 32 bits."""
    return _mixed(F.shiftright(slot, 32).bitwiseAND(0xFFFFFFFF).bitwiseXOR(source))


def shard_of(key: Column, slot: Column, shards: Column) -> Column:
    """The shard that a slot falls into: a hash of source and slot, modulo the number of shards."""
    return F.pmod(_mixed(slot.bitwiseAND(0xFFFFFFFF).bitwiseXOR(key)), shards)


def shard_counts(sources: DataFrame) -> DataFrame:
    """(rank, shard, drawn, first): how many slots of a source each shard draws, and the first of their numbers.

    sources: rank, slots and shards (the number of all shards). Slots are counted where they are made, so only counts
    are shuffled.
    """
    chunks = sources.filter("slots > 0").select("rank", "slots", "shards", source_key(F.col("rank")).alias("source"), F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(slots - 1) div {_SLOT_CHUNK}"))).alias("chunk"))
    chunks = chunks.repartition(shuffle_partitions(sources.sparkSession), "rank", "chunk")
    first = F.col("chunk") * _SLOT_CHUNK
    slots = chunks.select("rank", "shards", slot_key(F.col("source"), first).alias("key"), F.explode(F.sequence(first, F.least(first + _SLOT_CHUNK, F.col("slots")) - 1)).alias("slot"))
    drawn = slots.groupBy("rank", shard_of(F.col("key"), F.col("slot"), F.col("shards")).alias("shard")).agg(F.count(F.lit(1)).alias("drawn"))
    drawn = materialize(drawn.withColumn("part", F.expr(f"shard div {SHARD_GROUP}")), "drawn")
    before = Window.partitionBy("rank").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    groups = drawn.groupBy("rank", "part").agg(F.sum("drawn").alias("n")).select("rank", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("rank", "part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    drawn = drawn.withColumn("local", F.coalesce(F.sum("drawn").over(within), F.lit(0)))
    return drawn.join(groups.hint("merge"), ["rank", "part"]).select("rank", "shard", "drawn", (F.col("base") + F.col("local")).alias("first"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, rank, source_size, target) from rows of (source, size)."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    per = per.withColumn("rank", rank.cast("long")).withColumn("w", weight).withColumn("cap", F.col("source_size") * float(max_repeat))
    before = Window.orderBy(F.col("cap") / F.col("w"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy(F.col("cap") / F.col("w"), "rank")
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = left / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    per = per.withColumn("level", level)
    level = F.max(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level"))).over(whole)
    per = per.withColumn("water", F.coalesce(level, F.lit(0.0)))
    return per.select("source", "rank", "source_size", F.least("cap", F.col("water") * F.col("w")).alias("target"))


def slot_plan(targets: DataFrame, block_tokens: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(rank, slot, shard, epoch, block, take): the blocks of the mix; take is how many of a block's tokens are used.

    Each pass over a source uses each block once. The last pass stops where the target is reached. A shard's slots of a
    source are as many as it drew.
    """
    spark = targets.sparkSession
    size, rank = F.col("source_size"), F.col("rank")
    t = targets.filter(size > 0).withColumn("need", F.round("target").cast("long"))
    t = t.withColumn("shards", F.ceil(F.sum("need").over(Window.partitionBy()) / shard_tokens).cast("long"))
    t = t.withColumn("blocks", F.ceil(size / block_tokens).cast("long")).withColumn("epochs", F.expr("need div source_size"))
    t = t.withColumn("rest", F.col("need") - F.col("epochs") * size)
    t = t.withColumn("last_len", size - (F.col("blocks") - 1) * block_tokens)
    t = t.withColumn("last_at", permuted(F.col("blocks") - 1, F.col("blocks"), rank, F.col("epochs"), inverse=True))
    full = F.col("last_at") * block_tokens
    over = F.col("rest") + block_tokens - F.col("last_len")
    t = t.withColumn("whole", F.when(F.col("rest") <= full, F.expr(f"rest div {block_tokens}")).when(F.col("rest") < full + F.col("last_len"), F.col("last_at")).otherwise(F.floor(over / block_tokens).cast("long")))
    t = t.withColumn("part", F.when(F.col("rest") <= full, F.col("rest") % block_tokens).when(F.col("rest") < full + F.col("last_len"), F.col("rest") - full).otherwise(over % block_tokens))
    t = t.withColumn("slots", F.col("epochs") * F.col("blocks") + F.col("whole") + (F.col("part") > 0).cast("long"))
    t = t.select("rank", "blocks", "epochs", "whole", "part", "last_len", "slots", "shards")
    drawn = shard_counts(t).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(drawn - 1) div {_SLOT_CHUNK}"))))
    drawn = drawn.join(t.drop("slots", "shards").hint("merge"), "rank").repartition(shuffle_partitions(spark), "rank", "shard", "chunk")
    at = F.col("first") + F.col("chunk") * _SLOT_CHUNK
    s = drawn.select("rank", "shard", "blocks", "epochs", "whole", "part", "last_len", F.explode(F.sequence(at, F.least(at + _SLOT_CHUNK, F.col("first") + F.col("drawn")) - 1)).alias("slot"))
    s = s.withColumn("epoch", F.expr("slot div blocks")).withColumn("place", F.col("slot") % F.col("blocks"))
    s = s.withColumn("block", permuted(F.col("place"), F.col("blocks"), rank, F.col("epoch")))
    length = F.when(F.col("block") == F.col("blocks") - 1, F.col("last_len")).otherwise(F.lit(block_tokens).cast("long"))
    take = F.when((F.col("epoch") < F.col("epochs")) | (F.col("place") < F.col("whole")), length).otherwise(F.col("part"))
    return s.select("rank", "slot", "shard", "epoch", "block", take.alias("take"))


def packed(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows of (doc_id, source, size, file) with rank, source_size, target and the token offset in their source."""
    t = targets.select(F.col("source").alias("__s"), "rank", "source_size", "target")
    d = sizes.join(t, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    known = F.col("doc_id").isNotNull()
    d = d.withColumn("bucket", F.when(known, F.pmod(F.col("doc_id").cast("long") + F.col("size"), F.lit(BUCKETS))).otherwise(F.col("size") + BUCKETS))
    d = d.withColumn("part", F.when(known, F.lit(0)).otherwise(F.col("file")))
    per = d.groupBy("rank", "bucket", "part").agg(F.sum("size").alias("in_bucket"))
    run = Window.partitionBy("rank").orderBy("bucket", "part").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("rank", "bucket", "part", F.coalesce(F.sum("in_bucket").over(run), F.lit(0)).alias("base"))
    own = Window.partitionBy("rank", "bucket", "part").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("local", F.coalesce(F.sum("size").over(own), F.lit(0)))
    return d.join(per.hint("merge"), ["rank", "bucket", "part"]).withColumn("offset", F.col("base") + F.col("local")).drop("bucket", "part", "file", "base", "local")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, weights=WEIGHTS, block_tokens: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS, max_repeat: int = MAX_REPEAT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, pieces, plan) of the mix.

    documents: doc_id, source, size, rank, source_size, target, offset. plan: see slot_plan(). pieces: for each
    document and block, the tokens of the document in it: rank, block, offset, doc_id, start and stop (within the block).
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    sizes = materialize(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), F.spark_partition_id().alias("file")), "sizes")
    targets = materialize(source_targets(sizes, weights, max_repeat), "targets")
    documents = packed(sizes, targets)
    last = F.col("offset") + F.col("size") - 1
    pieces = documents.filter("size > 0").select("rank", "doc_id", "offset", "size", F.explode(F.sequence(F.expr(f"offset div {block_tokens}"), F.floor(last / block_tokens).cast("long"))).alias("block"))
    at = F.col("block") * block_tokens
    pieces = pieces.select("rank", "block", "doc_id", "offset", (F.greatest(F.col("offset"), at) - at).alias("start"), (F.least(last + 1, at + block_tokens) - at).alias("stop"))
    return documents, pieces, slot_plan(targets, block_tokens, shard_tokens)


def taken(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (tokens of the document in the mix, repeats counted) and first_shard.

    first_shard: the least output shard that holds tokens of the document; null if none does.
    """
    documents, pieces, plan = mix(docs, id_col, text_col, source_col, **options)
    used = plan.groupBy("rank", "block").agg(F.collect_list(F.struct("take", "shard")).alias("uses"))
    tokens = lambda u: F.greatest(F.lit(0).cast("long"), F.least(F.col("stop"), u["take"]) - F.col("start"))
    got = F.aggregate(F.col("uses"), F.lit(0).cast("long"), lambda a, u: a + tokens(u))
    shard = F.array_min(F.transform(F.filter("uses", lambda u: tokens(u) > 0), lambda u: u["shard"]))
    # no side has a size bound, so none is broadcast
    got = pieces.join(used.hint("merge"), ["rank", "block"]).groupBy("rank", "offset").agg(F.sum(got).alias("__got"), F.min(shard).alias("__shard"))
    got = got.select("rank", "offset", "__got", "__shard", F.lit(True).alias("__full"))
    out = documents.withColumn("__full", F.col("size") > 0).join(got.hint("merge"), ["rank", "offset", "__full"], "left")
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("__got", F.lit(0)).cast("long").alias("taken"), F.col("__shard").alias("first_shard"))
