"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Each document of a source expects the same number of copies, the source's target
over its size. Along a fixed order of the source's documents these expectations
are summed; one random offset per source shifts the sum, and a document is taken
once for each integer that its step crosses. Ordering by size makes the words
taken follow the target closely.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugeline.llm.common import words

#: No source is asked for more than this many times its size.
MOST = 3
#: Weights by rank of the source's name, repeating.
WEIGHTS = (1, 2, 3)
#: Positions are numbered within (source, stratum, chunk), so that a source with
#: most of the rows is dealt to many tasks.
CHUNKS = 64
#: Strata of size to one natural logarithm.
STRATA = 10
SEED = 42


def offset(source: Column, seed: int) -> Column:
    """A fraction in [0, 1) of 16 bits that depends on source and seed alone."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), source), F.lit("n")))
    return F.conv(F.substring(F.md5(named.cast("binary")), 1, 4), 16, 10).cast("double") / F.lit(65536.0)


def targets(sizes: DataFrame, *, weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """Each source's target from (source, source_size): one row a source.

    A target is ``level * weight`` or, where that is more, ``most`` times the
    size; the level is the one at which targets add up to all sizes. A source
    is at its limit exactly if all targets at the level of its own limit do not
    exceed the total, so one pass in order of limit by weight finds them all.
    That pass is one task over one row a source: sources are labels, some
    thousands of them, not pages or domains.
    """
    listed = F.array(*(F.lit(int(w)) for w in weights))
    named = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weighed = named.withColumn("weight", F.element_at(listed, (F.col("rank") % len(weights) + 1).cast("int")).cast("long")).withColumn("limit", F.lit(most) * F.col("source_size"))
    ordered = Window.orderBy(F.col("limit") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy()
    level = (
        weighed.withColumn("total", F.sum("source_size").over(whole))
        .withColumn("all_weight", F.sum("weight").over(whole))
        .withColumn("asked", F.sum("limit").over(ordered).cast("double") + F.col("limit").cast("double") / F.col("weight") * (F.col("all_weight") - F.sum("weight").over(ordered)))
        .withColumn("limited", F.col("asked") <= F.col("total").cast("double"))
        .withColumn("left", F.col("total") - F.coalesce(F.sum(F.when(F.col("limited"), F.col("limit"))).over(whole), F.lit(0)))
        .withColumn("left_weight", F.sum(F.when(~F.col("limited"), F.col("weight"))).over(whole))
    )
    target = F.when(F.col("limited"), F.col("limit").cast("double")).otherwise((F.col("left") * F.col("weight")).cast("double") / F.col("left_weight"))
    return level.select("source", "source_size", target.alias("target"), offset(F.col("source"), seed).alias("shift"))


def chunk_of(rows: DataFrame, chunks: int) -> Column:
    """The chunk of a row by its key: whole numbers by remainder, other keys by hash."""
    key = F.col("doc_id") if rows.schema["doc_id"].dataType.typeName() in ("byte", "short", "integer", "long") else F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id"))
    return F.coalesce(F.pmod(key.cast("long"), F.lit(chunks)), F.lit(-1))


def places(rows: DataFrame, *, weights: Sequence[int], most: int, seed: int, chunks: int) -> DataFrame:
    """(doc_id, source, size) counted, with the place of the first along its source's order and the source's goal."""
    rows = rows.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.withColumn("stratum", F.floor(F.log((F.col("size") + 1).cast("double")) * F.lit(float(STRATA)))).withColumn("chunk", chunk_of(rows, chunks))
    cells = rows.groupBy("source", "stratum", "chunk").agg(F.sum("n").alias("held"), F.sum(F.col("n") * F.col("size")).alias("words"))
    goals = targets(cells.groupBy("source").agg(F.sum("words").alias("source_size")), weights=weights, most=most, seed=seed)
    order = Window.partitionBy("source").orderBy("stratum", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("base", F.coalesce(F.sum("held").over(order), F.lit(0))).drop("held", "words")
    cells = cells.alias("c").join(goals.alias("g"), F.col("c.source").eqNullSafe(F.col("g.source"))).select("c.*", "source_size", "target", "shift")
    within = Window.partitionBy("source", "stratum", "chunk").orderBy("size", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    # null-safe throughout: a plain equality would filter one use of ``rows`` only, and texts would be read and counted twice
    same = reduce(Column.__and__, (F.col(f"r.{name}").eqNullSafe(F.col(f"c.{name}")) for name in ("source", "stratum", "chunk")))
    placed = rows.withColumn("upto", F.coalesce(F.sum("n").over(within), F.lit(0))).alias("r").join(cells.alias("c"), same)
    return placed.select("r.doc_id", "r.source", "r.size", "r.n", (F.col("c.base") + F.col("r.upto") + 1).alias("first"), "source_size", "target", "shift")


def copies(place: Column, goal: Column, most: int) -> Column:
    """How many integer boundaries the step at a place crosses; goal has source_size, target and shift."""
    rate = F.when(goal["source_size"] > 0, goal["target"] / goal["source_size"]).otherwise(F.lit(0.0))
    crossed = F.floor(place * rate + goal["shift"]) - F.floor((place - 1) * rate + goal["shift"])
    return F.least(crossed, F.lit(most)).cast("long")


def mix(df: DataFrame, *, key: str = "doc_id", source: str = "source", size: Column | None = None, weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: int = SEED, chunks: int = CHUNKS) -> DataFrame:
    """Every row with its size, its source's size and target, and its copies in the mix.

    ``size`` defaults to the words of ``text``; null text has size 0 and null is
    a source of its own, last by name. Rows that agree in key, source and size
    are counted together and take consecutive places. Documents of a source of
    size 0 are not taken. Other columns are ignored; no rows give no rows.
    """
    size = words(F.col("text")) if size is None else size
    rows = df.select(F.col(key).alias("doc_id"), F.col(source).cast("string").alias("source"), size.alias("size"))
    placed = places(rows, weights=weights, most=most, seed=seed, chunks=chunks)
    each = placed.withColumn("place", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1))).withColumn("copies", copies(F.col("place"), F.struct("source_size", "target", "shift"), most))
    return each.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixed_rows(df: DataFrame, *, weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: int = SEED, chunks: int = CHUNKS) -> DataFrame:
    """The rows of the mix, whole, each as often as it is taken; words of ``text`` count as size.

    The same copies as ``mix`` gives; rows that agree in doc_id, source and size
    get theirs in any order. Other columns go along, whatever they are called.
    """
    home_of = F.md5(F.to_json(F.struct(F.col("doc_id").cast("string").alias("k"), F.col("source").cast("string").alias("s"), "size")))
    sized = df.select("doc_id", F.col("source").cast("string").alias("source"), words(F.col("text")).alias("size"))
    placed = places(sized, weights=weights, most=most, seed=seed, chunks=chunks).select(home_of.alias("home"), F.struct("first", "source_size", "target", "shift").alias("goal"))
    rows = df.select(F.struct("*").alias("row"), words(F.col("text")).alias("size")).select("row", "size", F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("source"))
    rows = rows.select("row", home_of.alias("home")).withColumn("nth", F.row_number().over(Window.partitionBy("home").orderBy("home")))
    taken = rows.join(placed, "home").withColumn("copies", copies(F.col("goal.first") + F.col("nth") - 1, F.col("goal"), most))
    return taken.where(F.col("copies") > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


#: The same rows of the query in DuckDB.
ORACLE = rf"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, CAST(rank % 3 + 1 AS BIGINT) AS weight, {MOST} * source_size AS lim, sum(source_size) OVER () AS total FROM s),
a AS (SELECT *, sum(lim) OVER o::DOUBLE + lim::DOUBLE / weight * (sum(weight) OVER () - sum(weight) OVER o) <= total::DOUBLE AS limited FROM w
      WINDOW o AS (ORDER BY lim / weight, rank ROWS UNBOUNDED PRECEDING)),
t AS (SELECT source, source_size,
             CASE WHEN limited THEN lim::DOUBLE
                  ELSE ((total - coalesce(sum(lim) FILTER (limited) OVER (), 0)) * weight)::DOUBLE / (sum(weight) FILTER (NOT limited) OVER ())::DOUBLE END AS target,
             CAST('0x' || substr(md5(concat('{SEED}:', coalesce('s' || source, 'n'))), 1, 4) AS BIGINT) / 65536.0::DOUBLE AS shift
      FROM a),
p AS (SELECT doc_id, source, size, row_number() OVER (PARTITION BY source ORDER BY floor(ln((size + 1)::DOUBLE) * {STRATA}.0::DOUBLE), coalesce(((doc_id % {CHUNKS}) + {CHUNKS}) % {CHUNKS}, -1), size, doc_id) AS place FROM d),
c AS (SELECT p.doc_id, p.source, p.size, t.source_size, t.target,
             CAST(least(floor(place * coalesce(target / nullif(source_size, 0), 0) + shift) - floor((place - 1) * coalesce(target / nullif(source_size, 0), 0) + shift), {MOST}) AS BIGINT) AS copies
      FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, copies * size AS taken FROM c
"""
