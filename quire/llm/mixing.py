"""Mixing sources to target weights, with exact budgets.

Each document gets a hash-random key. Within a source, documents are sorted by key in
ranges of keys: sums per range first, their running totals next, and a running total inside each
range last, so no task sorts more than a range. A source's target is cut into whole
epochs and a rest; each document is taken once an epoch, and once more, whole or in part,
while the running total is below the rest.

Targets: sources by code point, null last, have the weights in turn; they share
``share`` of all sizes by weight, and none gets more than ``most`` times its own size: what
is above goes to the others by weight. That ends at min(cap, level * weight) for one level,
which is found in one pass over the sources in order of cap / weight.

Nulls and edge cases: a null text has size 0; null sources form one source, the last; a null
doc_id is kept as null; rows that repeat a doc_id are documents of their own with equal
keys, told apart by text hash, then taken in one order; sources of size 0 have target 0;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window, functions as F

from quire.llm.workspace import stored

#: Documents in a range of keys, about.
RANGE_DOCS = 4096
#: Largest number of sources whose row of targets is broadcast (under 100 bytes each).
BROADCAST_SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("bigint"), F.lit(0))


def source_targets(sizes: DataFrame, weights: list[int], share: Fraction, most: int) -> DataFrame:
    """(source, source_size, target) from rows (source, source_size, ...)."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    k = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weighted = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (k + 1).cast("int")))
    weighted = weighted.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    full = F.col("cap") / F.col("weight")
    order = Window.orderBy(full, F.col("source").asc_nulls_last())
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    stepped = weighted.withColumns(
        {
            # the level if just the sources before this one, in order of cap / weight, are at their
            # caps; it rises up to the source where that is so and falls after it
            "level": (F.sum("source_size").over(everything) * F.lit(share.numerator) / F.lit(float(share.denominator)) - F.coalesce(F.sum("cap").over(upto), F.lit(0.0)))
            / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))),
        }
    )
    level = F.max("level").over(everything)
    return stepped.withColumn("target", F.least(F.col("cap"), level * F.col("weight"))).select("source", "source_size", "target", "ranges")


def mix_sources(docs: DataFrame, weights: list[int], share: Fraction = Fraction(3, 2), most: int = 2, seed: str = "mix", with_tie: bool = False) -> DataFrame:
    """(doc_id, size, source, source_size, target, taken) of each document; ``taken`` counts the words
    that the mix takes of it, repeats included, and sums to the floor of its source's target. ``tie`` is the text's hash, if asked for."""
    sized = docs.select("doc_id", "source", word_count("text").alias("size"), F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("/" + seed))).alias("key"), F.xxhash64("text").alias("tie"))
    sized = stored(sized, "sized")  # texts are read once
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.greatest(F.lit(1), F.ceil(F.count("*") / RANGE_DOCS)).cast("bigint").alias("ranges"))
    targets = source_targets(totals, weights, share, most)
    spread = 1 if (few := totals.count() <= BROADCAST_SOURCES) else 64
    side = F.broadcast(targets) if few else targets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    docs_side = sized.withColumn("salt", F.lit(0) if few else F.pmod(F.xxhash64("key"), F.lit(spread)).cast("int"))
    side = side.withColumn("salt", F.lit(0)) if few else side
    joined = docs_side.join(side, docs_side.source.eqNullSafe(side.source) & (docs_side.salt == side.salt)).select("doc_id", "size", docs_side.source, "key", "tie", "source_size", "target", "ranges")
    # the first 13 hex digits are a number below 2**52; ranges cut it evenly
    unit = F.conv(F.substring("key", 1, 13), 16, 10).cast("double") / F.lit(float(16**13))
    ranged = joined.withColumn("range", F.floor(unit * F.col("ranges")).cast("bigint"))
    sums = ranged.groupBy("source", "range").agg(F.sum("size").alias("in_range"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("source").alias("s"), F.col("range").alias("r"), F.coalesce(F.sum("in_range").over(before), F.lit(0)).alias("range_start"))
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(starts, placed.source.eqNullSafe(starts.s) & (placed.range == starts.r))
    budget = F.floor("target").cast("bigint")
    epochs = F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as bigint) div source_size")).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size")
    extra = F.least(F.col("size"), F.greatest(F.lit(0), rest - F.col("range_start") - F.col("before")))
    return placed.select("doc_id", "size", "source", "source_size", "target", (epochs * F.col("size") + extra).cast("bigint").alias("taken"), *["tie"] * with_tie)


def mix_sql(weights: list[int], share: Fraction = Fraction(3, 2), most: int = 2, seed: str = "mix", table: str = "documents") -> str:
    """The same rows in DuckDB: one running total a source, without ranges."""
    values = ", ".join(f"{float(w)!r}" for w in weights)
    return rf"""
with sized as (
  select doc_id, source, md5(coalesce(cast(doc_id as varchar), '') || '/{seed}') as key,
         cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size from {table}),
totals as (select source, cast(sum(size) as bigint) as source_size from sized group by source),
weighted as (
  select *, [{values}][1 + (row_number() over (order by source nulls last) - 1) % {len(weights)}] as weight,
         source_size * {float(most)!r} as cap from totals),
stepped as (
  select *,
         (cast(sum(source_size) over () as bigint) * {share.numerator} / cast({share.denominator} as double)
            - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0.0))
          / (sum(weight) over ()
            - coalesce(sum(weight) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0.0)) as level
  from weighted),
targets as (
  select source, source_size, least(cap, (max(level) over ()) * weight) as target from stepped),
placed as (
  select s.doc_id, s.size, t.source_size, t.target, cast(floor(t.target) as bigint) as budget,
         cast(coalesce(sum(s.size) over (partition by s.source order by s.key, s.doc_id rows between unbounded preceding and 1 preceding), 0) as bigint) as before
  from sized s join targets t on s.source is not distinct from t.source)
select doc_id, size, source_size, target,
       cast(case when source_size = 0 then 0 else (budget // source_size) * size
            + least(size, greatest(0, budget % source_size - before)) end as bigint) as taken
from placed"""
