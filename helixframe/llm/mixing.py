"""Mixing sources to target weights by capped water-filling.

Contract of every function here: a null text has size 0; a null source is a source of its own (last in
order); repeated rows are separate documents; an empty table gives an empty result; other columns of the
documents are carried along untouched, whatever their names (internal columns start with ``_mix_``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, cut, scratch, table

#: Documents of a source are ordered by a seeded hash; running sums go over this many hash ranges first.
RANGES_HEX = 3


def size_of(text: Column) -> Column:
    """Number of words between ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _key(source: Column) -> Column:
    """A source without nulls, so that equi-joins and windows see the null source as a value."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))


def cyclic_weights(sources: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """Adds ``_mix_weight``: the weights in turn over the sources by code point, null last.

    One row for each source goes through one window; documents do not.
    """
    n = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn("_mix_weight", F.element_at(F.array(*map(F.lit, weights)), (n % len(weights) + 1).cast("int")).cast("long"))


def water_fill(sources: DataFrame, share: float, max_epochs: int) -> DataFrame:
    """Adds ``target``: shares of ``share`` x all sizes by weight, none above max_epochs x its source's size.

    Clamping the worst source and resharing until all are feasible ends at the level where sources in order
    of size / weight are clamped up to the first that has room; that level comes from running sums.
    """
    order = Window.orderBy((F.col("source_size") / F.col("_mix_weight")), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    s = (
        sources.withColumn("_mix_cap", F.col("source_size") * max_epochs)
        .withColumn("_mix_total", F.sum("source_size").over(everything))
        .withColumn("_mix_left", F.col("_mix_total") * F.lit(share) - F.coalesce(F.sum("_mix_cap").over(before), F.lit(0)))
        .withColumn("_mix_w", F.sum("_mix_weight").over(rest))
        .withColumn("_mix_free", F.col("_mix_cap") * F.col("_mix_w") >= F.col("_mix_weight") * F.col("_mix_left"))
    )
    s = s.withColumn("_mix_level", F.min(F.when(F.col("_mix_free"), F.struct((-F.col("_mix_w")).alias("a"), F.col("_mix_left").alias("b"), F.col("_mix_w").alias("w")))).over(everything))
    shared = F.col("_mix_weight") * F.col("_mix_level.b") / F.col("_mix_level.w")
    target = F.when(F.col("_mix_free") & F.col("_mix_level").isNotNull(), shared).otherwise(F.col("_mix_cap").cast("double"))
    return s.select("source", "_mix_key", "source_size", target.cast("double").alias("target"))


def plan(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, max_epochs: int = 2, seed: int = 17, keep: dict[str, Column] | None = None) -> DataFrame:
    """For each document: size, source_size, target of its source, repetitions and taken words.

    A source's documents all get floor(target / size) repetitions; the rest of the target goes to documents in
    an order of a seeded hash of doc_id, each whole, as long as its middle lies within the rest. So a
    source misses its target by half a document at most, and no document is taken more than max_epochs times. Rows without
    doc_id are ordered by their text's hash in its place. keep names more columns of docs to take along.
    """
    kept = keep or {}
    h = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col("text"), F.lit("")))), F.lit(f":{seed}")))
    narrow = docs.select("doc_id", "source", *[x.alias(f"_mix_keep_{c}") for c, x in kept.items()], size_of(F.col("text")).alias("size"), h.alias("_mix_h"))
    narrow = cut(narrow.withColumn("_mix_key", _key(F.col("source"))).withColumn("_mix_range", F.substring("_mix_h", 1, RANGES_HEX)), "mix-sizes")

    ranges = narrow.groupBy("_mix_key", "_mix_range").agg(F.sum("size").alias("_mix_words"))
    totals = narrow.groupBy("_mix_key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    targets = water_fill(cyclic_weights(totals, weights), share, max_epochs).drop("source")
    within = Window.partitionBy("_mix_key").orderBy("_mix_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_mix_before", F.coalesce(F.sum("_mix_words").over(within), F.lit(0))).drop("_mix_words")
    ranges = cut(ranges.join(targets, "_mix_key"), "mix-ranges")

    joined = narrow.join(ranges, ["_mix_key", "_mix_range"])
    ahead = Window.partitionBy("_mix_key", "_mix_range").orderBy("_mix_h", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_mix_before") + F.coalesce(F.sum("size").over(ahead), F.lit(0))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size")))).otherwise(F.lit(0)).cast("long")
    out = joined.withColumn("_mix_whole", whole).withColumn("_mix_start", start)
    more = F.when(2 * F.col("_mix_start") + F.col("size") < 2 * (F.col("target") - F.col("_mix_whole") * F.col("source_size")), 1).otherwise(0)
    out = out.withColumn("repetitions", F.col("_mix_whole") + more)
    return out.select("doc_id", "source", *[F.col(f"_mix_keep_{c}").alias(c) for c in kept], "size", "source_size", "target", "repetitions", (F.col("size") * F.col("repetitions")).alias("taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: each document as many times as plan() says, with its own columns.

    The row that plan() decides on is found again by doc_id, source, size and text. Where several rows agree in all of them,
    their repetitions are counted together and dealt to them in turn.
    """
    columns = docs.columns
    # two numbers without nulls stand for what identifies a row, so that the join and the numbering share one shuffle
    one = F.coalesce(F.col("doc_id").cast("long"), F.lit(0))
    two = F.xxhash64(F.col("doc_id").isNull(), F.col("source").isNull(), "source", F.coalesce(F.col("text"), F.lit("")))
    with scratch():
        plans = plan(docs.select("doc_id", "source", "text"), keep={"_mix_one": one, "_mix_two": two}, **options)
        decided = plans.groupBy("_mix_one", "_mix_two").agg(F.count("*").alias("_mix_rows"), F.sum("repetitions").alias("_mix_all"))
        decided = cut(decided.where("_mix_all > 0"), "mix-plan", keep=True)
    numbered = docs.withColumn("_mix_one", one).withColumn("_mix_two", two).withColumn("_mix_k", F.row_number().over(Window.partitionBy("_mix_one", "_mix_two").orderBy(F.lit(0))))
    each = F.floor(F.col("_mix_all") / F.col("_mix_rows")) + F.when(F.col("_mix_k") <= F.col("_mix_all") % F.col("_mix_rows"), 1).otherwise(0)
    joined = numbered.join(decided, ["_mix_one", "_mix_two"]).withColumn("_mix_n", each.cast("int")).where("_mix_n > 0")
    return joined.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_n")))).select(*[F.col(f"`{c}`") for c in columns])


def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    return plan(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("source", "repetitions")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS k,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) || ':17') AS h FROM documents),
t AS (SELECT k, any_value(source) AS source, sum(size)::BIGINT AS source_size FROM d GROUP BY k),
w AS (SELECT *, (CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END)::BIGINT AS weight FROM t),
c AS (SELECT *, 2 * source_size AS cap,
        sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(2 * source_size) OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_words,
        sum(weight) OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w FROM w),
f AS (SELECT *, cap * w >= weight * left_words AS free FROM c),
l AS (SELECT left_words AS lb, w AS lw FROM f WHERE free ORDER BY w DESC LIMIT 1),
g AS (SELECT f.*, CASE WHEN free THEN weight * lb / lw ELSE cap::DOUBLE END AS target FROM f, l),
a AS (SELECT d.doc_id, d.size, g.source_size, g.target,
        CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size)::BIGINT ELSE 0 END AS whole,
        coalesce(sum(d.size) OVER (PARTITION BY d.k ORDER BY d.h, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM d JOIN g USING (k))
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN 2 * start + size < 2 * (target - whole * source_size) THEN 1 ELSE 0 END))::BIGINT AS taken FROM a
"""
