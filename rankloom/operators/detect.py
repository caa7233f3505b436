"""Where labelled entities stand in their feature's measurements; entities are found by id or by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.scalar import lower_alnum, upper_key
from rankloom.session import materialised


def ranged_ranks(rows: DataFrame, by: list[str], value: str, tie: str, parts: int = 64) -> DataFrame:
    """Adds rank (from 1, highest ``value`` first, then ``tie``) and n, the rows of ``by``.

    Rows of a group are sorted in ranges of values, cut at approximate percentiles, and the sizes of the ranges above are
    added, so a large group isn't sorted by one task. Rows without a value must be gone.
    """
    rows = materialised(rows)
    shares = [i / parts for i in range(1, parts)]
    cuts = rows.groupBy(*by).agg(F.percentile_approx(value, shares, 10_000).alias("__cuts"))
    placed = rows.join(cuts, by).withColumn("__part", F.size(F.filter("__cuts", lambda c: c > F.col(value)))).drop("__cuts")
    sizes = placed.groupBy(*by, "__part").agg(F.count(F.lit(1)).alias("__rows"))
    group = Window.partitionBy(*by)
    above = F.coalesce(F.sum("__rows").over(group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*by, "__part", above.alias("__above"), F.sum("__rows").over(group).alias("n"))
    nth = F.row_number().over(Window.partitionBy(*by, "__part").orderBy(F.desc(value), tie))
    return placed.withColumn("__nth", nth).join(sizes, [*by, "__part"]).withColumn("rank", F.col("__above") + F.col("__nth")).drop("__part", "__nth", "__above")


def grams(name: Column, length: Column) -> Column:
    """The distinct pieces of a name of so many characters."""
    starts = F.when(F.char_length(name) >= length, F.sequence(F.lit(1), F.char_length(name) - length + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(name, i, length)))


def pieces_like(needles: DataFrame, names: DataFrame) -> DataFrame:
    """The rows of names (name and others), one for each distinct piece of the name that is as long as some needle, as ``needle``.

    A name of L characters gives at most L pieces for each length that needles have, whatever the number of needles.
    """
    lengths = needles.agg(F.collect_set(F.char_length("needle")).alias("__lengths"))
    rows = names.crossJoin(F.broadcast(lengths)).withColumn("__length", F.explode("__lengths")).drop("__lengths")
    return rows.withColumn("needle", F.explode(grams(F.col("name"), F.col("__length")))).drop("__length")


def containing(needles: DataFrame, names: DataFrame) -> DataFrame:
    """(needle, DepMap_ID) of all names (DepMap_ID, name) that contain a needle; both are normalised and not empty.

    A needle is looked up whole among the pieces of names that are as long as it is, so only names that contain it meet it.
    """
    return needles.select("needle").distinct().join(pieces_like(needles, names), "needle").select("needle", "DepMap_ID")


def detect(labels: DataFrame, values: DataFrame, names: DataFrame) -> DataFrame:
    """The labels (query, DepMap_ID, name, relation) with match_by, status, rank, n, top_percent and found_id.

    values: query, DepMap_ID, value, with null where an entity is there but not measured. names: DepMap_ID, name. A label with an id is
    found by it. Others are found by their name, up to case and signs; if no measured entity of the feature has it, by the names
    that contain it; of several entities the one of best rank counts. Status: NOT IN PANEL (the feature has no rows), NOT FOUND, VALUE
    MISSING (the id is there without a value), else by the share of measured entities at or above it: positives are
    OK in the first 10 %, WEAK in the first half; negatives OK from 75 %, WEAK from 50 %; else CONTRADICTED. A blank name is not found. Repeated labels
    get one result each; an empty table gives no rows.
    """
    labels = labels.select(upper_key(F.col("query")).alias("query"), F.nullif(upper_key(F.col("DepMap_ID")), F.lit("")).alias("DepMap_ID"), "name", F.lower(F.trim("relation")).alias("relation"))
    values = values.select(upper_key(F.col("query")).alias("query"), upper_key(F.col("DepMap_ID")).alias("found_id"), "value")
    names = names.select(upper_key(F.col("DepMap_ID")).alias("found_id"), lower_alnum(F.col("name")).alias("name")).where("name <> ''")
    ranked = materialised(ranged_ranks(values.where("value IS NOT NULL"), ["query"], "value", "found_id").select("query", "found_id", "rank", "n"))
    asked = labels.select("query", "DepMap_ID", F.when(F.col("DepMap_ID").isNull(), lower_alnum(F.coalesce("name", F.lit("")))).alias("needle")).distinct()
    # Ranks are unique within a query, so the least one tells the entity; names and needles that many entities share leave one row each.
    least = F.min("rank").alias("rank")
    named = materialised(ranked.join(names, "found_id").groupBy("query", "name").agg(least))
    by_id = asked.withColumn("found_id", F.col("DepMap_ID")).join(ranked, ["query", "found_id"]).groupBy("query", "DepMap_ID", "needle").agg(least)
    by_name = asked.join(named.withColumnRenamed("name", "needle"), ["query", "needle"])
    rest = asked.where("needle <> ''").join(by_name, ["query", "needle"], "left_anti")
    loose = rest.join(pieces_like(rest, named).groupBy("query", "needle").agg(least), ["query", "needle"])
    found = lambda hits, loose: hits.select("query", "DepMap_ID", "needle", "rank", F.lit(loose).alias("loose"))
    hits = found(by_id, False).unionByName(found(by_name, False)).unionByName(found(loose, True)).join(ranked, ["query", "rank"])
    hits = hits.withColumn("hit", F.struct("found_id", "rank", "n"))
    sizes = values.groupBy("query").agg(F.count("value").alias("measured"))
    there = values.where("value IS NULL").select("query", F.col("found_id").alias("DepMap_ID"), F.lit(True).alias("unmeasured")).distinct()
    keyed = labels.withColumn("needle", F.when(F.col("DepMap_ID").isNull(), lower_alnum(F.coalesce("name", F.lit("")))))
    key = lambda c: F.coalesce(c, F.lit(""))
    hits = hits.select(F.col("query").alias("__q"), key(F.col("DepMap_ID")).alias("__i"), key(F.col("needle")).alias("__n"), "hit", "loose")
    out = keyed.join(hits, (F.col("query") == F.col("__q")) & (key(F.col("DepMap_ID")) == F.col("__i")) & (key(F.col("needle")) == F.col("__n")), "left")
    out = out.join(sizes, "query", "left").join(there, ["query", "DepMap_ID"], "left")
    top = 100.0 * (F.col("hit.rank") - 1) / F.greatest(F.col("hit.n") - 1, F.lit(1))
    judged = lambda good, weak: F.when(good, "OK").when(weak, "WEAK").otherwise("CONTRADICTED")
    status = (
        F.when(F.col("measured").isNull(), "NOT IN PANEL")
        .when(F.col("hit").isNull() & F.coalesce("unmeasured", F.lit(False)), "VALUE MISSING")
        .when(F.col("hit").isNull(), "NOT FOUND")
        .when(F.col("relation") == "positive", judged(top <= 10, top <= 50))
        .otherwise(judged(top >= 75, top >= 50))
    )
    match_by = F.when(F.col("DepMap_ID").isNotNull(), "id").when(F.col("loose"), "contained name").when(F.col("hit").isNotNull(), "name")
    return out.select("query", "DepMap_ID", "name", "relation", match_by.alias("match_by"), status.alias("status"), F.col("hit.rank").alias("rank"), F.col("measured").alias("n"), top.alias("top_percent"), F.col("hit.found_id").alias("found_id"))
