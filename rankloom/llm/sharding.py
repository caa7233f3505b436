"""Proportional stratified interleaving: shards of equal row counts whose source mixture matches the whole."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import discard, exact_cumsum, exact_rank, stored

#: Rows that one sorted bucket holds on average.
BUCKET_ROWS = 50_000
#: A group of more than one BIG-th of a shard's rows is big. There are fewer than BIG + 1 big groups for each shard.
BIG = 16


def _buckets(n: int) -> int:
    """A power of two from 256 to 65,536."""
    return min(65_536, max(256, 1 << (max(1, n // BUCKET_ROWS) - 1).bit_length()))


def past(at: Column, ends: list[int]) -> Column:
    """How many of the ends a place has reached: the shard it lies in."""
    return sum((F.when(at >= F.lit(end), 1).otherwise(0) for end in ends), F.lit(0)).cast("int")


def most_room_first(groups: DataFrame, rooms: list[int], name: str) -> tuple[DataFrame, list[int]]:
    """Few groups (group, m, first), largest first, each put whole where most room is: (group, shard) of those that fit, and the rooms left."""
    row = groups.agg(F.sort_array(F.collect_list(F.struct((-F.col("m")).alias("m"), "first", "group"))).alias("g"))
    start = f"named_struct('room', array({', '.join(f'{r}L' for r in rooms)}), 'out', cast(array() AS array<struct<group:string,shard:int>>))"
    spot = "int(array_position(acc.room, array_max(acc.room))) - 1"
    moved = f"named_struct('room', transform(acc.room, (r, i) -> if(i = {spot}, r + x.m, r)), 'out', concat(acc.out, array(named_struct('group', x.group, 'shard', {spot}))))"
    done = stored(row.select(F.expr(f"aggregate(g, {start}, (acc, x) -> if(array_max(acc.room) >= -x.m, {moved}, acc))").alias("d")).select("d.*"), name)
    return done.select(F.inline("out")), done.first()["room"]


def interleave(
    docs: DataFrame, n_shards: int = 16, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """Deals all rows into ``n_shards`` shards; the law is ``rows``: counts differ by one at most.

    Rows are shuffled by md5(seed:id) and ranked within their source; sorted by the fractional rank
    (rank + 0.5) / rows of the source they interleave all sources in proportion, and the order is cut into
    runs. Rows of equal text form a group, which stays whole in one shard. Big groups (of more than a
    BIG-th of a shard) are placed first, the largest first, each where most room is. The other groups are laid
    out in interleaved order over the room that is left, so that each shard gets its share of them; a group
    that reaches beyond its shard's room (one a shard at most) goes where most room is then. Only groups that
    have no room anywhere, as those larger than a shard, are dealt row by row like single rows, which fill all
    shards to their exact counts in interleaved order.

    Nulls: a null text has size 1 and crc 0 and is equal to other null texts only; null sources are one
    source of their own; null ids shuffle as the text ``null``. Repeated rows are rows of one group. An
    empty table gives an empty result. Other columns are ignored. No group of rows meets in one task.

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard, and source.
    """
    n = docs.count()
    parts, span = _buckets(n), max(n, 1)
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.octet_length(text).cast("long"), F.lit(0)) + F.lit(1),
        F.col(source_col).alias("source"),
        F.coalesce(F.crc32(text), F.lit(0)).alias("text_crc32"),
        F.when(text.isNull(), F.lit("null")).otherwise(F.md5(text)).alias("group"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))).alias("mix"),
    ).toDF("doc_id", "size", "source", "text_crc32", "group", "mix")
    rows = rows.withColumn("stratum", F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")))
    # Texts are read once; all that follows is planned over narrow rows.
    read = stored(rows, "read")
    rows = read.withColumn("part", F.floor(F.conv(F.substring("mix", 1, 4), 16, 10).cast("int") * parts / 65_536))
    tie = [F.col("doc_id"), F.col("group")]
    rows = exact_rank(rows, ["stratum"], "part", [F.col("mix"), *tie], "rank")
    rows = rows.withColumn("fraction", (F.col("rank") + 0.5) / F.col("rank_total")).drop("part", "rank", "rank_total")
    rows = rows.withColumn("part", F.floor(F.col("fraction") * parts))
    rows = exact_rank(rows, [], "part", [F.col("fraction"), F.col("mix"), *tie], "pos")
    rows = stored(rows.drop("mix", "part", "stratum", "fraction", "pos_total"), "interleave")
    discard(read)

    part = lambda pos: F.expr(f"({pos} * {parts}L) div {span}L")
    targets = [(s + 1) * n // n_shards - s * n // n_shards for s in range(n_shards)]
    pick = lambda values: F.get(F.array(*map(F.lit, values)), F.col("shard"))
    copies = stored(rows.groupBy("group").agg(F.count(F.lit(1)).alias("m"), F.min("pos").alias("first")).where("m > 1"), "groups")
    big, rooms = most_room_first(copies.where((F.col("m") * BIG > n // n_shards) & (F.col("m") <= max(targets))), targets, "big")
    small = copies.where(F.col("m") * BIG <= n // n_shards).withColumn("part", part("first"))
    small = exact_cumsum(small, [], "part", [F.col("first")], F.col("m"), "at")
    spread = F.floor(F.col("at") / F.col("at_total") * float(sum(rooms)))
    small = small.withColumn("shard", past(spread, list(accumulate(rooms))))
    small = stored(exact_cumsum(small, ["shard"], "part", [F.col("first")], F.col("m"), "filled"), "small")
    fits = F.col("filled") + F.col("m") <= pick(rooms)
    taken = {r["shard"]: r["m"] for r in small.where(fits).groupBy("shard").agg(F.sum("m").alias("m")).collect()}
    late, rooms = most_room_first(small.where(~fits), [r - taken.get(s, 0) for s, r in enumerate(rooms)], "late")
    groups = big.unionByName(small.where(fits).select("group", "shard")).unionByName(late)
    ends = list(accumulate(rooms))

    joined = rows.join(groups, "group", "left")
    whole = joined.where("shard is not null").select("doc_id", "size", "source", "text_crc32", "pos", "shard")
    single = exact_rank(joined.where("shard is null").drop("shard").withColumn("part", part("pos")), [], "part", [F.col("pos")], "q")
    single = single.withColumn("shard", past(F.col("q"), ends)).select(*whole.columns)
    dealt = stored(whole.unionByName(single).withColumn("part", part("pos")), "dealt")
    discard(rows, copies, big, small, late)
    dealt = exact_rank(dealt, ["shard"], "part", [F.col("pos")], "slot")
    return dealt.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source"
    )
