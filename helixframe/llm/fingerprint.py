"""Threshold-scaled sketches: every shingle hash below a fixed fraction of the hash range is kept.

DataFrame functions only. Sketches of parts merge by union, and containment between documents of very unequal
length is estimated from the kept hashes alone.

Contract: a null text is the empty text; texts of fewer than five words have one shingle of all their words, and
none if they have no word; texts of up to SHORT shingles keep all of them; equal texts have equal fingerprints; repeated
rows stay separate rows; rows with equal or null doc_id are ordered among each other by their text's hash (null ids come
after all others); an empty table gives an empty result; columns other than doc_id and text are never read.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table

WORDS = 5
#: One hash in KEEP_ONE_IN is kept.
KEEP_ONE_IN = 4
#: Text bytes that one range of doc_ids should hold; a range is what one task orders.
RANGE_BYTES, MOST_RANGES = 16_000_000, 65_536
#: Shingles up to which a sketch keeps all hashes: a fraction of so few says little.
SHORT = 32


def _bound(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda variable is not expanded again inside inner lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _limit(keep_one_in: int) -> Column:
    """The hash under which one hash in so many lies."""
    return F.lit(-(2**63) + 2**64 // keep_one_in)


def sketch(text: Column, words: int = WORDS, keep_one_in: int = KEEP_ONE_IN) -> Column:
    """Struct of n (shingles, repeats counted), whole (a hash of the shingle list) and kept (sorted distinct hashes).

    Texts of up to SHORT shingles keep all hashes.
    """
    split = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    limit = _limit(keep_one_in)

    def shingles(w: Column) -> Column:
        n = F.size(w)
        count = F.when(n == 0, F.lit(0)).otherwise(F.greatest(n - (words - 1), F.lit(1)))
        return F.when(count == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, F.lit(words)))))

    def packed(h: Column) -> Column:
        kept = F.array_sort(F.array_distinct(F.filter(h, lambda x: (x < limit) | (F.size(h) <= SHORT))))
        return F.struct(F.size(h).alias("n"), F.xxhash64(h).alias("whole"), kept.alias("kept"))

    hashed = _bound(split, lambda w: F.transform(w, lambda x: F.xxhash64(x)))
    return _bound(_bound(hashed, shingles), packed)


def as_text(s: Column) -> Column:
    """The sketch as a string: shingle count, hash of the shingle list, kept hashes in hexadecimal."""
    kept = F.concat_ws("", F.transform(s["kept"], lambda x: F.lpad(F.hex(x), 16, "0")))
    return F.lower(F.concat_ws(":", s["n"].cast("string"), F.hex(s["whole"]), kept))


def merge(sketches: Column, keep_one_in: int = KEEP_ONE_IN) -> Column:
    """The kept hashes of a document whose parts have these sketches (shingles across parts aside)."""
    total = F.aggregate(sketches, F.lit(0), lambda n, s: n + s["n"])
    every = F.array_sort(F.array_distinct(F.flatten(F.transform(sketches, lambda s: s["kept"]))))
    return _bound(total, lambda n: F.filter(every, lambda x: (x < _limit(keep_one_in)) | (n <= SHORT)))


def _ratio(a: Column, b: Column, size_of, keep_one_in: int) -> Column:
    def of(x: Column) -> Column:
        # a sketch of all hashes meets one of a fraction at that fraction
        mixed = (x["a"]["n"] <= SHORT) != (x["b"]["n"] <= SHORT)
        kept = lambda k: F.when(mixed, F.filter(x[k]["kept"], lambda h: h < _limit(keep_one_in))).otherwise(x[k]["kept"])
        same = (x["a"]["n"] == x["b"]["n"]) & (x["a"]["whole"] == x["b"]["whole"])

        def estimate(y: Column) -> Column:
            common, na, nb = F.size(F.array_intersect(y["a"], y["b"])), F.size(y["a"]), F.size(y["b"])
            return F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(common / F.greatest(size_of(na, nb, common), F.lit(1)))

        return F.when(same, F.lit(1.0)).otherwise(_bound(F.struct(kept("a").alias("a"), kept("b").alias("b")), estimate))

    return _bound(F.struct(a.alias("a"), b.alias("b")), of)


def likeness(a: Column, b: Column, keep_one_in: int = KEEP_ONE_IN) -> Column:
    """Estimated Jaccard similarity; 1 for equal shingle lists, else 0 where either keeps nothing."""
    return _ratio(a, b, lambda na, nb, common: na + nb - common, keep_one_in)


def containment(a: Column, b: Column, keep_one_in: int = KEEP_ONE_IN) -> Column:
    """Estimated share of the smaller document's shingles that the other has too."""
    return _ratio(a, b, lambda na, nb, common: F.least(na, nb), keep_one_in)


def _partition_keys(n: int) -> list[int]:
    """For each of n partitions an integer that hash partitioning sends there."""
    spark = SparkSession.active()
    tries = spark.range(0, 12 * n + 64, 1, 1).select("id", F.pmod(F.hash(F.col("id")), F.lit(n)).alias("p")).groupBy("p").agg(F.min("id").alias("id")).collect()
    found = {r["p"]: r["id"] for r in tries}
    return [found.get(p, p) for p in range(n)]  # one that no try met (rare) shares another's partition


def dealt_by_id(docs: DataFrame) -> DataFrame:
    """doc_id and text dealt into ranges of doc_id of RANGE_BYTES or so, a partition each, with guard rows.

    Adds _fp_key (doc_id), _fp_tie (the text's hash, which orders rows of equal doc_id), _fp_range and _fp_guard: the first row
    of a range in descending order comes a second time, as the guard of the range before it, so that each range holds the
    row that follows its last one. Rows without doc_id come last and have ranges of their own, by the text's hash.
    The driver and a broadcast hold a few numbers for each range (MOST_RANGES at most).
    """
    none = F.col("doc_id").isNull()
    keyed = docs.select("doc_id", "text", F.coalesce(F.col("doc_id"), F.lit(-(2**63))).cast("long").alias("_fp_key"), F.xxhash64("text").alias("_fp_tie"))
    size = F.octet_length("text")
    known, unknown = keyed.agg(F.sum(F.when(none, 0).otherwise(size)), F.sum(F.when(none, size))).first()
    ranges, null_ranges = (int(min(MOST_RANGES // 2, max(1, (x or 0) // RANGE_BYTES))) for x in (known, unknown))
    cuts = keyed.where(~none).select(F.percentile_approx("_fp_key", [k / ranges for k in range(1, ranges)], 4 * ranges)).first()[0] if ranges > 1 else []
    cuts = sorted(set(cuts or []))

    def range_of(key: Column) -> Column:
        # binary search among the cuts: the number of cuts below key
        if not cuts:
            return F.lit(0)
        points = F.array(*map(F.lit, cuts)).cast("array<bigint>")
        step = lambda s, _: F.when(s["lo"] >= s["hi"], s).otherwise(F.when(F.get(points, ((s["lo"] + s["hi"]) / 2).cast("int")) < key, F.struct((((s["lo"] + s["hi"]) / 2).cast("int") + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), ((s["lo"] + s["hi"]) / 2).cast("int").alias("hi"))))
        return F.aggregate(F.sequence(F.lit(1), F.lit(len(cuts).bit_length() + 1)), F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi")), step, lambda s: s["lo"])

    # ranges without doc_id are -1, -2 and so on, by the upper 32 bits of the hash: ascending hashes, descending ranges
    share = F.shiftright(F.col("_fp_tie"), 32) + 2**31
    keyed = keyed.withColumn("_fp_range", F.when(none, -1 - F.floor(share * null_ranges / 2**32).cast("int")).otherwise(range_of(F.col("_fp_key"))))
    first = F.min(F.struct(F.bitwise_not("_fp_key").alias("key"), F.col("_fp_tie").alias("tie")))
    tops = {r[0]: r[1] for r in keyed.groupBy("_fp_range").agg(first).collect()}
    order = sorted(tops, reverse=True)
    if not order:
        return keyed.withColumn("_fp_guard", F.lit(0))
    places = dict(zip(order, _partition_keys(len(order)), strict=True))
    # The first row of a range guards the range before it; that of the very first one guards the last.
    rows = [(r, ~tops[r]["key"], tops[r]["tie"], places[r], places[order[i - 1]]) for i, r in enumerate(order)]
    kind = "array<struct<_fp_range:int,_fp_top:bigint,_fp_least:bigint,_fp_own:bigint,_fp_before:bigint>>"
    names = ("_fp_range", "_fp_top", "_fp_least", "_fp_own", "_fp_before")
    bounds = keyed.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps([dict(zip(names, r, strict=True)) for r in rows])), kind)))
    joined = keyed.join(F.broadcast(bounds), "_fp_range")
    own = F.array(F.struct(F.col("_fp_own").alias("range"), F.lit(0).alias("guard")))
    is_first = (F.col("_fp_key") == F.col("_fp_top")) & (F.col("_fp_tie") == F.col("_fp_least"))
    twice = F.when(is_first, F.array_append(own, F.struct(F.col("_fp_before").alias("range"), F.lit(1).alias("guard")))).otherwise(own)
    spread = joined.select("doc_id", "text", "_fp_key", "_fp_tie", F.inline(twice))
    return spread.withColumnsRenamed({"range": "_fp_range", "guard": "_fp_guard"}).repartition(len(order), "_fp_range")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of each text, of its edited text, and how near they and the next document are.

    The edited text has the last third of the code points replaced by as many first ones of the next document, that of the
    next lower doc_id (the last is followed by the first). Texts alone are shuffled, once; sketches are made after that.
    """
    base = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    dealt = dealt_by_id(base).withColumn("sketch", sketch(F.col("text")))
    by = Window.partitionBy("_fp_range").orderBy("_fp_guard", F.col("_fp_key").desc(), "_fp_tie")
    out = dealt.withColumn("next", F.lead(F.struct("text", "sketch")).over(by)).where("_fp_guard = 0").withColumn("n_chars", F.char_length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - third).cast("int")), F.substring(F.col("next.text"), F.lit(1), third))
    out = out.withColumn("edited", edited).select("doc_id", "n_chars", "sketch", F.col("next.sketch").alias("next_sketch"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), sketch(F.col("edited")).alias("edited_sketch"))
    return out.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("contained_edited"),
        containment(F.col("sketch"), F.col("next_sketch")).alias("contained_next"),
    )


def op6_threshold_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
