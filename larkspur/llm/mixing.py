"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue. Its documents stand in shuffled order, once for each of EPOCHS passes, and each
gets a virtual finish time: the source's words up to its end, divided by the source's weight. The mix
is all entries in the order of finish times, cut where their words reach the total budget. As each queue
is served in proportion to its weight until it has been read EPOCHS times, the words taken from a
source come to its target within about a document.

Running sums need no task to hold a source: words are summed by (source, leading bits of the shuffle
hash), those sums are accumulated, and each small bucket is then accumulated on its own. Rows of one id and size stand at one place, as one row with
their number, so that an id that many rows share, or none, fills no bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import cut, sized

EPOCHS = 3
WEIGHTS = (1, 2, 3)
#: Hexadecimal digits of the hash that name a bucket, at least; more where a bucket would hold more than about BUCKET_ROWS rows.
BUCKET_DIGITS = 3
BUCKET_ROWS = 1 << 16
WORD = "[^\\x20\\x09-\\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def shuffled(ident: Column, seed: int) -> Column:
    """The place of a document in its shuffled queue: the first 64 bits, in hexadecimal, of the md5 of its id and the seed."""
    return F.substring(F.md5(F.concat(F.coalesce(ident.cast("string"), F.lit("")), F.lit(f":{seed}"))), 1, 16)


def bucket_digits(rows: int) -> int:
    return min(16, max(BUCKET_DIGITS, -(-max(0, (rows // BUCKET_ROWS).bit_length()) // 4)))


def targets(sizes: DataFrame, epochs: int = EPOCHS, weights: tuple = WEIGHTS) -> DataFrame:
    """source, weight, source_size, target, one row per source (null is a source, the last one).

    Weights go by the code points of source, repeating. The budget is all words; level is the common
    virtual time up to which every source is served that does not end at epochs times its size before.
    The windows without a key hold one row per source.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(order) - 1
    ranked = per_source.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.lit(epochs) * F.col("source_size"))
    everything = Window.partitionBy()
    by_end = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest = by_end.rowsBetween(Window.unboundedPreceding, -1), by_end.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    filled = ranked.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(rest))
    filled = filled.withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(everything))
    return filled.select("source", "weight", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def finish(epoch: int) -> Column:
    return (F.col("upto") + epoch * F.col("source_size")) / F.col("weight")


def queues(df: DataFrame, text_col: str, id_col: str, source_col: str, seed: int, epochs: int, weights: tuple) -> tuple[DataFrame, float]:
    """For each row its id, source, hash (the place in the shuffled queue), size, copies (rows at this place), copy (which of these), source_size, target, weight and upto (words of its source up to its end); and the last finish time of the mix."""
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), n_words(F.col(f"`{text_col}`")).alias("size"))
    rows = cut(rows.withColumn("hash", shuffled(F.col("id"), seed)), "mix-sizes")
    aims = cut(targets(rows, epochs, weights), "mix-targets")
    places = rows.groupBy("source", "hash", "id", "size").agg(F.count("*").alias("copies")).withColumn("bucket", F.substring("hash", 1, bucket_digits(rows.count())))
    places = cut(places.withColumn("words", F.col("size") * F.col("copies")), "mix-places")
    group = F.struct("source", "bucket")
    sums = places.groupBy("source", "bucket").agg(F.sum("words").alias("words"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    sums = sums.join(aims.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).select(group.alias("group"), "before", "weight", "source_size", "target")
    inside = Window.partitionBy("group").orderBy("hash", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = places.withColumn("group", group).withColumn("within", F.sum("words").over(inside) - F.col("words")).join(sums, "group")
    summed = summed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).withColumn("upto", F.col("before") + F.col("within") + F.col("copy") * F.col("size"))
    summed = cut(summed.select("id", "source", "hash", "size", "copies", "copy", "source_size", "target", "weight", "upto"), "mix-queues")
    return summed, last_taken(summed.where("size > 0"), epochs)


def mix(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", seed: int = 17, epochs: int = EPOCHS, weights: tuple = WEIGHTS) -> DataFrame:
    """The id, size, source_size, target and taken of each document.

    taken is size times the number of passes (0 to epochs) in which the mix takes the document. A null or blank text
    has size 0 and is never taken; texts of any length count whole. The shuffle is a hash of the id, so reruns agree; rows of one id and size stand
    beside each other and are taken one by one. Other columns of df, whatever their names, are not read. An empty df gives an empty result.
    """
    summed, last = queues(df, text_col, id_col, source_col, seed, epochs, weights)
    taken = sum((F.when(finish(e) <= F.lit(last), F.col("size")).otherwise(F.lit(0)) for e in range(epochs)), F.lit(0).cast("long"))
    return summed.select(F.col("id").alias(id_col), "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_documents(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", seed: int = 17, epochs: int = EPOCHS, weights: tuple = WEIGHTS) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of df, whatever their names; texts do not shuffle.

    In each pass the mix takes a source's queue up to one place: a document is taken where its own place is not beyond. Of several rows at
    that last place, of one id and size, as many are taken as `mix` takes, by the hashes of their texts.
    """
    summed, last = queues(df, text_col, id_col, source_col, seed, epochs, weights)
    place = F.struct("hash", "id", "size", "copy", "copies")
    ends = cut(summed.groupBy("source").agg(*[F.max(F.when(finish(e) <= F.lit(last), place)).alias(f"end{e}") for e in range(epochs)]), "mix-ends")
    text, ident = F.col(f"`{text_col}`"), F.col(f"`{id_col}`")
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("doc"), F.col(f"`{source_col}`").alias("from"), F.struct(shuffled(ident, seed).alias("hash"), ident.alias("id"), n_words(text).alias("size")).alias("place"), text.alias("text"))
    rows = rows.join(sized(ends), F.col("from").eqNullSafe(F.col("source"))).where("place.size > 0")
    upto = lambda e: F.struct(*[F.col(f"end{e}.{c}") for c in ("hash", "id", "size")])
    at_end = lambda e: F.col(f"end{e}").isNotNull() & (F.col("place") == upto(e)) & (F.col(f"end{e}.copy") < F.col(f"end{e}.copies"))
    shared = F.lit(False)
    for e in range(epochs):
        shared = shared | F.coalesce(at_end(e), F.lit(False))
    whole = lambda e: F.coalesce(F.col(f"end{e}").isNotNull() & (F.col("place") <= upto(e)), F.lit(False))
    times = lambda taken: sum((F.when(taken(e), 1).otherwise(0) for e in range(epochs)), F.lit(0))
    out = [F.col("doc").getField(c).alias(c) for c in df.columns]
    copied = lambda d, n: d.withColumn("again", F.explode(F.array_repeat(F.lit(0), n))).select(*out)
    if ends.where(" OR ".join(f"end{e}.copy < end{e}.copies" for e in range(epochs))).isEmpty():
        return copied(rows, times(whole))
    last_ones = rows.where(shared).withColumn("copy", F.row_number().over(Window.partitionBy("from", "place").orderBy(F.xxhash64("text"), "text")))
    in_part = lambda e: F.coalesce(F.col(f"end{e}").isNotNull() & ((F.col("place") < upto(e)) | ((F.col("place") == upto(e)) & (F.col("copy") <= F.col(f"end{e}.copy")))), F.lit(False))
    return copied(rows.where(~shared), times(whole)).unionByName(copied(last_ones, times(in_part)))


def last_taken(summed: DataFrame, epochs: int) -> float:
    """The finish time at which the globally sorted entries reach the budget; -1 where nothing is taken."""
    budget = summed.agg(F.sum("size")).first()[0] or 0
    entries = summed.select("size", F.explode(F.array(*[finish(e) for e in range(epochs)])).alias("finish"))
    dealt = cut(entries.repartitionByRange("finish").select("finish", "size", F.spark_partition_id().alias("part")), "mix-entries")
    taken, last = 0, -1.0
    for part in dealt.groupBy("part").agg(F.sum("size").alias("words"), F.max("finish").alias("last")).orderBy("part").collect():  # one row per range partition
        if taken + part["words"] > budget:
            inside = dealt.where(F.col("part") == part["part"]).groupBy("finish").agg(F.sum("size").alias("words"))
            upto = inside.select("finish", F.sum("words").over(Window.orderBy("finish")).alias("upto"))
            best = upto.where(F.col("upto") <= budget - taken).agg(F.max("finish")).first()[0]
            return last if best is None else best
        taken, last = taken + part["words"], part["last"]
    return last
