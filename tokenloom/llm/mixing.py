"""Operator 10: mixing sources to target weights by Sainte-Lague apportionment, in DataFrame functions alone.

1. size = words of a text. Sources in code-point order (null last) weigh 3, 1, 2, repeating, and share 150 % of all words. A target stops at twice
   its source's words; the excess goes to the others by weight: with sources ordered by words per weight, all up to some place are full and
   the rest share what is left, which running sums tell without a loop.
2. Targets become whole blocks of BLOCK words: seats by highest quotients target / (2 s - 1). Rounding target / BLOCK gives all but
   |difference| seats; quotients of only so many next (or last) seats of each source settle the difference.
3. Each source is dealt into shards of about SHARD words by a hash of doc_id, and its blocks to the shards by the same rule with shard sizes as weights.
4. A shard's texts in seeded order are one run of words cut into blocks. Its quota is taken from the beginning, once around for every time the shard's words are
   used up, twice at most: so a text is taken 0, 1 or 2 times its size, or in part where a quota ends.

Texts are read once: sizes, sources and places in the order are written to the shared folder, and all that follows reads those. No task holds more than a shard, or one row for each source or
shard; no key is gathered. Nulls: a null text has size 0, a null source is a source of its own (last), a null doc_id is hashed as empty. Rows that are equal in all of doc_id, text and source take what their places in the order give. Empty texts take 0. Empty table: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tokenloom.sources.tables import written

WORD = "[^\\x20\\x09-\\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST = 1.5, 2.0
BLOCK = 64
SHARD = 1_000_000
SEED = "mix-1"


def apportion(rows: DataFrame, group: list[str], key: list[str], weight: str, seats: str) -> DataFrame:
    """rows and quota: whole seats for each row so that those of a group add up to its seats, by highest quotients weight / (2 s - 1). Ties go by key."""
    own = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))
    total = F.sum(weight).over(own)
    exact = F.when(total > 0, F.col(weight) * F.col(seats) / total).otherwise(0.0)
    near = rows.withColumn("_near", F.floor(exact + 0.5).cast("long"))
    near = near.withColumn("_gap", F.when(total > 0, F.col(seats) - F.sum("_near").over(own)).otherwise(F.lit(0)).cast("long"))
    # the seats that may still change hands: so many after the last one, or so many of the last ones
    first = F.when(F.col("_gap") > 0, F.col("_near") + 1).otherwise(F.greatest(F.lit(1), F.col("_near") + F.col("_gap") + 1))
    last = F.when(F.col("_gap") > 0, F.col("_near") + F.col("_gap")).otherwise(F.col("_near"))
    seats_open = F.when((F.col("_gap") != 0) & (last >= first), F.sequence(first, last))
    some = near.withColumn("_seat", F.explode_outer(seats_open))
    quotient = F.col(weight) / (2 * F.col("_seat") - 1)
    by = [F.col("_seat").isNull(), F.when(F.col("_gap") > 0, -quotient).otherwise(quotient), F.when(F.col("_gap") > 0, F.col("_seat")).otherwise(-F.col("_seat")), *key]
    moves = F.col("_seat").isNotNull() & (F.row_number().over(own.orderBy(*by)) <= F.abs("_gap"))
    moved = some.withColumn("_move", F.when(moves, F.signum("_gap")).otherwise(0.0).cast("long"))
    rest = [c for c in rows.columns if c not in group + key]
    out = moved.groupBy(*group, *key).agg(*(F.first(c).alias(c) for c in rest), (F.first("_near") + F.sum("_move")).alias("quota"))
    return out.select(*rows.columns, "quota")


def targets(sources: DataFrame) -> DataFrame:
    """sources (source, source_size) with weight and target."""
    place = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (place % len(WEIGHTS) + 1).cast("int"))
    rows = sources.withColumn("weight", weight)
    all_ = W.partitionBy(F.lit(0))
    upto = all_.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    full, heavy = F.coalesce(F.sum("source_size").over(upto), F.lit(0)), F.coalesce(F.sum("weight").over(upto), F.lit(0.0))
    # the words of a unit of weight if the sources before this one are full and it is not
    rows = rows.withColumn("level", (SHARE * F.sum("source_size").over(all_) - MOST * full) / (F.sum("weight").over(all_) - heavy))
    stops = F.col("level") * F.col("weight") >= MOST * F.col("source_size")
    rest = F.min(F.when(~stops, F.struct(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(all_)["level"]
    return rows.withColumn("rest", rest).select("source", "source_size", "weight", F.when(stops, MOST * F.col("source_size")).otherwise(F.col("rest") * F.col("weight")).alias("target"))


def _order(doc_id: Column, text: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.md5(text), F.lit(""))))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words; repeats counted) for each document. options: block, shard, seed."""
    return _mixed(docs, id_col, text_col, source_col, **options).drop("place")


def _mixed(docs: DataFrame, id_col: str, text_col: str, source_col: str, *, block: int = BLOCK, shard: int = SHARD, seed: str = SEED) -> DataFrame:
    """What mix() returns, and place: the hash of id and text that orders a shard."""
    order = _order(F.col(id_col), F.col(text_col), seed)
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), order.alias("place"))
    sized = written(sized, "sized")
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    sources = sources.withColumn("seats", F.round(F.sum("target").over(W.partitionBy(F.lit(0))) / block).cast("long"))
    sources = apportion(sources, [], ["source"], "target", "seats").withColumnRenamed("quota", "blocks")
    sources = sources.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard)).cast("long")).drop("seats", "weight")
    # one row for each source: a few bytes each, and Spark broadcasts it only if it is small
    dealt = sized.join(sources.withColumnRenamed("source", "own"), F.col("source").eqNullSafe(F.col("own"))).drop("own")
    dealt = dealt.withColumn("shard", F.pmod(F.conv(F.substring("place", 1, 8), 16, 10).cast("long"), "shards"))
    shards = dealt.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.first("blocks").alias("blocks"))
    quotas = apportion(shards, ["source"], ["shard"], "shard_size", "blocks")
    words = F.least(F.col("quota") * block, (MOST * F.col("shard_size")).cast("long"))
    quotas = quotas.select(F.col("source").alias("own"), F.col("shard").alias("part"), "shard_size", words.alias("words"))
    rows = dealt.join(quotas, F.col("source").eqNullSafe(F.col("own")) & (F.col("shard") == F.col("part")))
    run = W.partitionBy("source", "shard").orderBy("place", "doc_id").rowsBetween(W.unboundedPreceding, 0)
    begin = F.sum("size").over(run) - F.col("size")
    around = F.when(F.col("shard_size") > 0, F.floor(F.col("words") / F.col("shard_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.col("words") - around * F.col("shard_size")
    taken = around * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - begin))
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), "place")


def op10(spark, docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, *, seed: str = SEED, **options) -> DataFrame:
    """docs as the mix takes them: each as often as its taken words hold it, a part counting from one half. Rows equal in doc_id and text share what they take."""
    plan = _mixed(docs, "doc_id", "text", "source", seed=seed, **options).groupBy("place").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(F.lit(0)).cast("int")
    plan = plan.select(F.col("place").alias("of"), times.alias("times")).filter("times > 0")
    rows = docs.select(F.struct(*docs.columns).alias("row"), _order(F.col("doc_id"), F.col("text"), seed).alias("place"))
    return rows.join(plan, F.col("place") == F.col("of")).select("row", F.explode(F.sequence(F.lit(1), "times"))).select("row.*")
