"""Operator 8, mixing sources to target weights with a low-discrepancy schedule.

Slot i of the schedule has the golden-ratio point frac((i + 1) * phi); the point falls into one source's interval of the
cumulative target shares.  Slots are ranked per source, and slot k of a source takes block k (`block` words) of that
source's documents, laid end to end in shuffled order and repeated from the start when used up.
A source takes its target to the word: it has ceil(target / block) slots and its last block is cut.  Points give a source a few
slots more or less than that: further ones take nothing, and missing ones stand at golden-ratio places of their own, so
a source smaller than a block is not left out.

Ranks and positions come from two-level prefix sums, so one hot source is many bounded parts.
The schedule has about total / block slots; block is at most `most_block` words and at most total / `least_slots`.

Targets: all sizes together are shared by weight; a source's target is at most `most_repeats` times its size, and the
excess goes to the others by weight.  That is a water level: target = min(cap, weight * level).

Cases: null text or no words has size 0 and is never taken; null sources form one source, last; repeated rows are separate rows,
and rows of one id and size (ties) stand in any order next to each other, with the same takes in all; long texts are counted whole and
taken in pieces; an empty table, or one without words, gives targets and takes of 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellscape.llm.common import id_text, prefix_sums, stored, table

PHI = 0.6180339887498949


def word_count(name: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(name), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most_repeats: int = 3) -> DataFrame:
    """(sid, source, source_size, rows, weight, target) from rows (source, size): one row a source; sid numbers them."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    everything = W.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    by = by.withColumn("sid", F.row_number().over(everything).cast("long"))
    by = by.withColumn("weight", F.element_at(cycle, (F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1).cast("int")))
    by = by.withColumn("cap", F.col("source_size") * most_repeats)
    # Sources in the order in which the rising level reaches their caps; before each: caps already full, weight still open.
    rising = W.orderBy(F.col("cap") / F.col("weight"), "sid")
    before = rising.rowsBetween(W.unboundedPreceding, -1)
    rest = rising.rowsBetween(0, W.unboundedFollowing)
    total = F.sum("source_size").over(W.partitionBy(F.lit(1)))
    by = by.withColumn("level", (total - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(rest))
    by = by.withColumn("full", F.col("level") * F.col("weight") >= F.col("cap"))
    # Once a source is not full, no later one is; its level is the final one.
    final = F.min(F.when(~F.col("full"), F.struct((F.col("cap") / F.col("weight")).alias("r"), F.col("sid"), F.col("level").alias("l")))).over(W.partitionBy(F.lit(1)))
    by = by.withColumn("final", final["l"])
    return by.select("sid", "source", "source_size", "rows", "weight", F.when(F.col("full") | F.col("final").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("final") * F.col("weight"))).alias("target"))


def schedule(targets: DataFrame, slots: int, part: int = 65_536, cells: int = 1024) -> DataFrame:
    """(slot, sid, rank): which block of which source each slot takes; ranks from 0 in slot order.

    Points meet intervals by a cell of [0, 1): an equality join whatever the number of sources.  Ranks that no point gave a
    source stand between slots, at places that are fractions.
    """
    order = W.orderBy("sid").rowsBetween(W.unboundedPreceding, 0)
    upto = targets.filter("target > 0").withColumn("to", F.sum("target").over(order)).withColumn("from", F.col("to") - F.col("target"))
    total = F.max("to").over(W.partitionBy(F.lit(1)))
    bounds = upto.select("sid", "slots", (F.col("from") / total).alias("from"), (F.col("to") / total).alias("to"))
    wide = bounds.withColumn("cell", F.explode(F.sequence(F.floor(F.col("from") * cells), F.floor(F.col("to") * cells))))
    points = targets.sparkSession.range(slots).select(F.col("id").alias("slot"), ((F.col("id") + 1) * F.lit(PHI)).alias("x")).select("slot", (F.col("x") - F.floor("x")).alias("x"))
    points = points.withColumn("cell", F.floor(F.col("x") * cells))
    dealt = points.join(wide, "cell").filter((F.col("x") >= F.col("from")) & (F.col("x") < F.col("to"))).select("slot", "sid", "slots")
    dealt = dealt.withColumn("part", F.floor(F.col("slot") / part)).withColumn("one", F.lit(1))
    ranked = prefix_sums(dealt, ["sid"], "part", [F.col("slot")], "one", "rank").select(F.col("slot").cast("double").alias("slot"), "sid", "rank", "slots")
    ranked = ranked.filter("rank < slots").drop("slots")
    have = ranked.groupBy("sid").agg(F.count("*").alias("have"))
    short = targets.filter("slots > 0").join(have, "sid", "left").select("sid", "slots", F.coalesce("have", F.lit(0)).alias("have")).filter("have < slots")
    late = short.select("sid", F.explode(F.sequence(F.col("have"), F.col("slots") - 1)).alias("rank"))
    place = (F.col("sid") + F.col("rank")) * F.lit(PHI)
    return ranked.union(late.select((F.floor((place - F.floor(place)) * slots) + 0.5).alias("slot"), "sid", "rank"))


def laid_out(rows: DataFrame, per_part: int = 50_000) -> DataFrame:
    """rows (row, doc_id, sid, size, rows) with `start`: the words before a row in its source's shuffled order.

    A part of a source is a range of the shuffle key's first 28 bits; a source of n rows has about n / per_part parts.  A range with
    many more rows than that (copies of one id) is cut by key, size and runs of row numbers.
    """
    rows = rows.withColumn("key", F.md5(id_text("doc_id")))
    parts = F.ceil(F.col("rows") / per_part)
    rows = rows.withColumn("range", F.floor(F.conv(F.substring("key", 1, 7), 16, 10).cast("long") * parts / F.lit(1 << 28)))
    # At most one row for every 4 * per_part rows.
    hot = F.broadcast(rows.groupBy("sid", "range").agg(F.count("*").alias("n")).filter(F.col("n") > 4 * per_part).select("sid", "range", F.lit(True).alias("hot")))
    rows = rows.join(hot, ["sid", "range"], "left")
    levels = [F.col("range"), *[F.when(F.col("hot"), x) for x in (F.col("key"), F.col("size"), F.shiftright("row", 14))]]
    rows = rows.withColumn("part", F.struct(*[x.alias(f"l{i}") for i, x in enumerate(levels)])).drop("hot", "range")
    return prefix_sums(rows, ["sid"], "part", [F.col("key"), F.col("doc_id"), F.col("size"), F.col("row")], "size", "start").drop("part", "key")


def pieces(placed: DataFrame, plan: DataFrame, block: int, most_repeats: int) -> DataFrame:
    """(slot, row, doc_id, first, words): each slot's pieces of documents, from word `first` of the document.

    Round r of a source lays its documents at r * source_size on; blocks cut that line every `block` words and where `words`, what
    the source takes, ends.
    """
    rounds = placed.filter("size > 0 and words > 0").withColumn("round", F.explode(F.sequence(F.lit(0), F.least(F.lit(most_repeats - 1), F.floor((F.col("words") - 1) / F.col("source_size")).cast("int")))))
    at = rounds.withColumn("at", F.col("start") + F.col("round") * F.col("source_size")).withColumn("end", F.least(F.col("at") + F.col("size"), "words")).filter("at < end")
    cut = at.withColumn("rank", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("end") - 1) / block))))
    lo, hi = F.greatest(F.col("at"), F.col("rank") * block), F.least("end", (F.col("rank") + 1) * block)
    cut = cut.select("sid", "rank", "row", "doc_id", (lo - F.col("at")).alias("first"), (hi - lo).alias("words"))
    return cut.join(plan, ["sid", "rank"]).select("slot", "row", "doc_id", "first", "words")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (1.0, 2.0, 3.0), most_repeats: int = 3, most_block: int = 4096, least_slots: int = 16_384) -> tuple[DataFrame, DataFrame]:
    """The mix as (rows, stream).

    rows: (row, doc_id, size, source_size, target, taken), one a row of docs; stream: (slot, row, doc_id, first, words), in training
    order by slot, where first and words say which words of the document the slot takes.
    """
    rows = stored(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text_col).alias("size")).withColumn("row", F.monotonically_increasing_id()))
    targets = stored(source_targets(rows, weights, most_repeats))
    total = targets.agg(F.sum("source_size")).first()[0] or 0
    block = int(max(1, min(most_block, total // least_slots)))
    targets = targets.withColumn("words", F.floor(F.col("target") + 0.5)).withColumn("slots", F.ceil(F.col("words") / block))
    plan = schedule(targets, -(-total // block))
    per = targets.withColumnRenamed("source", "of").drop("weight", "slots")
    placed = stored(laid_out(rows.join(per, rows["source"].eqNullSafe(per["of"])).drop("of", "source")))
    stream = pieces(placed, plan, block, most_repeats)
    taken = stream.groupBy("row").agg(F.sum("words").alias("taken"))
    out = placed.join(taken, "row", "left").select("row", "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    return out, stream


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))[0].select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH rows0 AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), by0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows0 GROUP BY source),
by1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS sid, source_size * 3 AS cap FROM by0),
by2 AS (SELECT *, CAST((sid - 1) % 3 + 1 AS DOUBLE) AS weight FROM by1),
by3 AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM by2
), by4 AS (SELECT *, lvl * weight >= cap AS filled FROM by3),
by5 AS (SELECT *, first_value(lvl) OVER (ORDER BY filled, cap / weight, sid) AS final, bool_and(filled) OVER () AS all_filled FROM by4),
targets AS (SELECT sid, source, source_size, CASE WHEN filled OR all_filled THEN CAST(cap AS DOUBLE) ELSE least(CAST(cap AS DOUBLE), final * weight) END AS target FROM by5),
placed AS (
  SELECT r.doc_id, r.size, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS words,
    coalesce(sum(r.size) OVER (PARTITION BY t.sid ORDER BY md5(coalesce(CAST(r.doc_id AS VARCHAR), '')), r.doc_id, r.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM rows0 r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN size = 0 THEN 0 ELSE
  greatest(0, least(size, words - start)) + greatest(0, least(size, words - source_size - start)) + greatest(0, least(size, words - 2 * source_size - start)) END AS BIGINT) AS taken
FROM placed
"""
