"""Operators on all pairs of samples: identity by state and by descent, principal components; rare-variant burden.

The number of samples is what a study has; variants are many. Each task turns its variants into genotype
matrices and adds up products of samples x samples; only those sums are shuffled, never variants.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import genotype as G
from ..functions.tests import once
from ..metadata import Study, metadata_of

BATCH = 2048


def _genotype_rows(df: DataFrame, study: Study, indexes: list[int]) -> DataFrame:
    """One row for each variant with g: 0, 1, 2 for biallelic diploid genotypes, -1 missing, -2 several alternates, -3 not diploid."""

    def code(gt: Column) -> Column:
        clean = F.coalesce(gt, F.lit("./."))
        dose = G.dosage(clean)  # settles all plain genotypes before any text is split
        return F.when(dose.isNotNull(), dose).when(F.size(G.alleles(clean)) != 2, -3).when(G.is_missing(clean), -1).when(G.multi_allelic(clean), -2).otherwise(-1).cast("byte")

    return df.select(F.transform(G.genotypes(F.col("studies"), study.id, indexes), code).alias("g"), F.transform(G.genotypes(F.col("studies"), study.id, indexes), lambda x: F.coalesce(x, F.lit("./."))).alias("gt"))


def _matrices(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
    for batch in batches:
        for start in range(0, batch.num_rows, BATCH):
            part = batch.slice(start, BATCH)
            yield part.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, n), part


def ibs(df: DataFrame, samples: list[str] | None = None, study: str = "", skip_reference: bool = False, skip_multi_allelic: bool = True) -> DataFrame:
    """samplePair, distance, counts [shared 0, 1, 2], variants and skip of every pair of samples.

    Skipped are genotypes that are not diploid or missing, pairs both homozygous reference with skip_reference, and
    several alternates with skip_multi_allelic (else shared alleles count as multiset intersection).
    distance is (shared 2 + shared 1 / 2) / variants.
    """
    chosen = metadata_of(df).first(study)
    names = samples or chosen.samples
    n = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = np.zeros((3, n, n))
        total = 0
        for g, part in _matrices(batches, n):
            total += len(g)
            a = [(g == k).astype(np.float32) for k in range(3)]
            two = sum(x.T @ x for x in a)
            none = a[0].T @ a[2]
            none = none + none.T
            called = sum(a)
            one = called.T @ called - two - none
            if skip_reference:
                two -= a[0].T @ a[0]
            if not skip_multi_allelic and (g == -2).any():
                rows = np.flatnonzero((g == -2).any(1))
                texts = part.column(1)
                for r in rows.tolist():
                    alleles = [sorted(t.replace("|", "/").split("/")) for t in texts[r].as_py()]
                    usable = [i for i in range(n) if g[r, i] in (-2, 0, 1, 2)]
                    for i in usable:
                        for k in usable:
                            if g[r, i] == -2 or g[r, k] == -2:
                                left, s = list(alleles[k]), 0
                                for x in alleles[i]:
                                    if x in left:
                                        left.remove(x)
                                        s += 1
                                (none, one, two)[s][i, k] += 1
            shared += np.stack([none, one, two])
        if total:
            i, k = np.triu_indices(n, 1)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(k), *(pa.array(shared[s][i, k].round().astype(np.int64)) for s in range(3)), pa.array(np.full(len(i), total))], ["i", "k", "s0", "s1", "s2", "total"])

    rows = _genotype_rows(df, chosen, chosen.indexes(names)).mapInArrow(run, "i long, k long, s0 long, s1 long, s2 long, total long")
    sums = rows.groupBy("i", "k").agg(*(F.sum(c).alias(c) for c in ("s0", "s1", "s2", "total")))
    name = F.array(*map(F.lit, names))
    variants = F.col("s0") + F.col("s1") + F.col("s2")
    return sums.orderBy("i", "k").select(
        F.array(F.get(name, F.col("i").cast("int")), F.get(name, F.col("k").cast("int"))).alias("samplePair"), F.try_divide(F.col("s2") + 0.5 * F.col("s1"), variants).alias("distance"),
        F.array("s0", "s1", "s2").alias("counts"), variants.alias("variants"), (F.col("total") - variants).alias("skip"),
    )


def expected_sharing(df: DataFrame, samples: list[str] | None = None, study: str = "") -> DataFrame:
    """One row: mean probabilities E00, E01, E02, E11, E12, E22 of sharing given descent, with finite-sample corrections."""
    chosen = metadata_of(df).first(study)
    rows = _genotype_rows(df, chosen, chosen.indexes(samples or chosen.samples))
    counted = once(F.filter("g", lambda x: x >= 0), lambda c: F.struct((2.0 * F.size(c)).alias("n"), F.aggregate(c, F.lit(0.0), lambda a, x: a + x).alias("y")))
    # equal genotype counts have equal terms: the formulas run once for each, not for each variant
    base = rows.select(counted.alias("c")).groupBy("c.n", "c.y").agg(F.count("*").alias("times"))
    base = base.where("n > 3").select("n", "y", "times", (F.col("n") - F.col("y")).alias("x")).where("x > 0 AND y > 0")
    n, x, y, times = (F.col(k) for k in ("n", "x", "y", "times"))
    p, q = x / n, y / n
    n3 = n * n * n / ((n - 1) * (n - 2) * (n - 3))
    n2 = n * n / ((n - 1) * (n - 2))
    e = {
        "E00": 2 * p * p * q * q * ((x - 1) / x) * ((y - 1) / y) * n3,
        "E01": 4 * p * p * p * q * ((x - 1) / x) * ((x - 2) / x) * n3 + 4 * p * q * q * q * ((y - 1) / y) * ((y - 2) / y) * n3,
        "E02": (p * p * p * p * ((x - 1) / x) * ((x - 2) / x) * ((x - 3) / x) + q * q * q * q * ((y - 1) / y) * ((y - 2) / y) * ((y - 3) / y) + 4 * p * p * q * q * ((x - 1) / x) * ((y - 1) / y)) * n3,
        "E11": 2 * p * p * q * ((x - 1) / x) * n2 + 2 * p * q * q * ((y - 1) / y) * n2,
        "E12": (p * p * p * ((x - 1) / x) + q * q * q * ((y - 1) / y) + p * p * q * ((x - 1) / x) + p * q * q * ((y - 1) / y)) * n2,
    }
    return base.agg(*(F.try_divide(F.sum(v * times), F.sum(times)).alias(k) for k, v in e.items()))


def ibd(df: DataFrame, samples: list[str] | None = None, study: str = "", skip_reference: bool = False, skip_multi_allelic: bool = True) -> DataFrame:
    """ibs() with IBD [z0, z1, z2] by the method of moments, bounded to probabilities, and PI_HAT.

    Each step is a lambda variable, so that no step's expression is repeated in the next one's.
    """
    pairs = ibs(df, samples, study, skip_reference, skip_multi_allelic)
    rows = pairs.crossJoin(expected_sharing(df, samples, study))  # one row
    one = lambda k: F.array(*(F.lit(1.0 if i == k else 0.0) for i in range(3)))

    def without(k: int, v: Column) -> Column:
        """A negative share becomes 0 and the other two add up to 1."""
        i, j = (x for x in range(3) if x != k)
        rest = F.get(v, F.lit(i)) + F.get(v, F.lit(j))
        parts = [F.lit(0.0) if x == k else F.try_divide(F.get(v, F.lit(x)), rest) for x in range(3)]
        return F.when(F.get(v, F.lit(k)) < 0, F.array(*parts)).otherwise(v)

    def moments(r: Column) -> Column:
        s = r["variants"]
        count = lambda k: F.get(r["counts"], F.lit(k))
        z2 = lambda z0, z1: F.try_divide(count(2) - z0 * r["E02"] * s - z1 * r["E12"] * s, s)
        z1 = lambda z0: once(F.try_divide(count(1) - z0 * r["E01"] * s, r["E11"] * s), lambda z: F.array(z0, z, z2(z0, z)))
        return once(F.try_divide(count(0), r["E00"] * s), z1)

    def bounded(z: Column) -> Column:
        kept = once(once(without(0, z), lambda v: without(1, v)), lambda v: without(2, v))
        over = [F.get(z, F.lit(k)) > 1 for k in range(3)]
        return F.when(over[0], one(0)).when(over[1], one(1)).when(over[2], one(2)).otherwise(kept)

    found = once(once(F.struct("counts", "variants", "E00", "E01", "E02", "E11", "E12"), moments), bounded)
    both = once(found, lambda z: F.struct(z.alias("IBD"), (F.get(z, F.lit(1)) / 2 + F.get(z, F.lit(2))).alias("PI_HAT")))
    return rows.withColumn("_ibd", both).select(*pairs.columns, "_ibd.IBD", "_ibd.PI_HAT")


def pca(df: DataFrame, study: str = "", k: int = 2) -> DataFrame:
    """sampleId and PCA, the scores of each sample on the first k components of the centred genotype matrix.

    Missing genotypes count as the variant's mean. The samples x samples matrix of products is summed up over
    tasks (its size is bounded by the study's samples) and its eigenvectors give the scores; the largest
    absolute score of each component is positive.
    """
    from pyspark.ml.linalg import Vectors, VectorUDT
    from pyspark.sql.types import StringType, StructField, StructType

    chosen = metadata_of(df).first(study)
    n = len(chosen.samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((n, n))
        for g, _ in _matrices(batches, n):
            x = np.where(g >= 0, g, np.nan).astype(float)
            count = (g >= 0).sum(1)
            x, count = x[count > 0], count[count > 0]
            mean = np.nansum(x, 1) / count
            x = np.where(np.isnan(x), mean[:, None], x) - mean[:, None]
            gram += x.T @ x
        i, j = np.nonzero(np.ones((n, n)))
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(gram[i, j])], ["i", "j", "v"])

    rows = _genotype_rows(df, chosen, list(range(n))).mapInArrow(run, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    gram = np.zeros((n, n))
    gram[rows["i"], rows["j"]] = rows["v"]
    centre = np.eye(n) - 1 / n
    values, vectors = np.linalg.eigh(centre @ gram @ centre)
    order = np.argsort(-values)[:k]
    scores = vectors[:, order] * np.sqrt(np.maximum(values[order], 0))
    scores *= np.where(scores[np.abs(scores).argmax(0), np.arange(len(order))] < 0, -1, 1)
    schema = StructType([StructField("sampleId", StringType()), StructField("PCA", VectorUDT())])
    return df.sparkSession.createDataFrame([(s, Vectors.dense(row)) for s, row in zip(chosen.samples, scores.tolist(), strict=True)], schema)


def hotelling(x: np.ndarray | None, gram: np.ndarray | None, n1: int, orders: np.ndarray) -> np.ndarray:
    """T-square of each order of the samples, whose first n1 are the cases; near-zero eigenvalues count as none.

    x is the design (samples x columns); for more columns than samples gram, x @ x.T, says it all: the within-group
    covariance has the non-zero eigenvalues of the samples' products, so no matrix of columns x columns is made.
    """
    n = orders.shape[1]
    n2 = n - n1
    scale, free = n1 * n2 / n, n - 2
    if gram is None:
        side = np.zeros((len(orders), n))
        np.put_along_axis(side, orders[:, :n1], 1, 1)
        if x.shape[1] == 1:
            return hotelling_single(x.T, n1, orders)[0]
        products, total = x.T @ x, x.sum(0)
        floor = max(1e-8, 1e-13 * np.trace(products))
    else:
        # orthonormal contrasts within each side
        contrasts = np.zeros((free, n))
        for at, first, size in ((0, 0, n1), (n1 - 1, n1, n2)):
            for k in range(1, size):
                contrasts[at + k - 1, first : first + k], contrasts[at + k - 1, first + k] = 1, -k
                contrasts[at + k - 1] /= np.sqrt(k * (k + 1))
        difference = np.r_[np.full(n1, 1 / n1), np.full(n2, -1 / n2)]
        floor = max(1e-8, 1e-13 * np.trace(gram))
    out = []
    step = max(1, 2**21 // (n if gram is not None else x.shape[1]) ** 2)
    for at in range(0, len(orders), step):
        part = orders[at : at + step]
        if gram is None:
            cases = side[at : at + step] @ x
            m1, m2 = cases / n1, (total - cases) / n2
            pooled = (products - n1 * m1[:, :, None] * m1[:, None, :] - n2 * m2[:, :, None] * m2[:, None, :]) / free
            values, vectors = np.linalg.eigh(pooled)
            along = np.einsum("kij,ki->kj", vectors, m1 - m2) ** 2
            weight = np.where(np.abs(values) > floor, values, np.inf)
        else:
            of = gram[part[:, :, None], part[:, None, :]]
            values, vectors = np.linalg.eigh(contrasts @ of @ contrasts.T / free)
            along = np.einsum("kij,ki->kj", vectors, (of @ difference) @ contrasts.T) ** 2 / free
            weight = np.where(np.abs(values) > floor, values, np.inf) ** 2
        out.append(scale * (along / weight).sum(1))
    return np.concatenate(out)


def hotelling_single(y: np.ndarray, n1: int, orders: np.ndarray) -> np.ndarray:
    """hotelling() of many designs of one column each (groups x samples): groups x orders. Sums are of whole numbers."""
    n = y.shape[1]
    n2 = n - n1
    side = np.zeros((len(orders), n))
    np.put_along_axis(side, orders[:, :n1], 1, 1)
    s1, q1 = y @ side.T, (y * y) @ side.T
    s2, q2 = y.sum(1, keepdims=True) - s1, (y * y).sum(1, keepdims=True) - q1
    pooled = ((n1 * q1 - s1 * s1) / n1 + (n2 * q2 - s2 * s2) / n2) / (n - 2)
    return n1 * n2 / n * ((n2 * s1 - n1 * s2) / (n1 * n2)) ** 2 / np.maximum(pooled, 1e-8)


def f_tail(f: float, d1: int, d2: int) -> float:
    """Upper tail of the F distribution, by the regularised incomplete beta function's continued fraction."""
    import math

    if not f > 0:
        return 1.0
    a, b, x = d2 / 2, d1 / 2, d2 / (d2 + d1 * f)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0

    def fraction(a: float, b: float, x: float) -> float:
        c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
        h = d
        for m in range(1, 300):
            for t in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / ((1 + t * d) or 1e-300)
                c = (1 + t / c) or 1e-300
                h *= d * c
            if abs(d * c - 1) < 1e-16:
                break
        return h

    return front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b


#: Bytes of genotypes that are summed up at a time, and with that the largest cell that burden_parts() hands over (or so).
SLICE = 1 << 20


def burden_parts(batches: Iterator[pa.RecordBatch], n: int, maf: float) -> Iterator[pa.RecordBatch]:
    """Rows (group, g: doses) as a row for each group and slice: variants, rare ones and the sum of their doses, and
    of the common ones the doses, or the products of samples where that is less."""
    for batch in batches:
        for start in range(0, batch.num_rows, max(1, SLICE // n)):
            part = batch.slice(start, max(1, SLICE // n))
            keys = part.column(0).dictionary_encode()
            codes = keys.indices.to_numpy()
            order = np.argsort(codes, kind="stable")
            g = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)[order]
            firsts = np.searchsorted(codes[order], np.arange(len(keys.dictionary)))
            rare = g.sum(1, dtype=np.int64) / n / 2 < maf
            sums = np.add.reduceat(np.where(rare[:, None], g, 0), firsts, 0, dtype=np.int32)
            counts, few = np.diff(firsts, append=len(g)), np.add.reduceat(rare.astype(np.int64), firsts)
            doses, grams = [None] * len(firsts), [None] * len(firsts)
            for k in np.flatnonzero(counts > few).tolist():
                rows = slice(firsts[k], firsts[k] + counts[k])
                common = g[rows][~rare[rows]]
                if len(common) <= 8 * n:
                    doses[k] = common.astype(np.uint8).tobytes()
                else:
                    x = common.astype(np.float64)
                    grams[k] = (x.T @ x).astype(np.int64).tobytes()
            yield pa.RecordBatch.from_arrays([keys.dictionary, pa.array(counts), pa.array(few), pa.array([r.tobytes() for r in sums], pa.binary()), pa.array(doses, pa.binary()), pa.array(grams, pa.binary())], ["group", "variants", "rare", "sums", "doses", "gram"])


def burden_tests(batches: Iterator[pa.RecordBatch], n1: int, n: int, permutations: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Tests of the groups whose parts come sorted by group. A group's common variants are held as doses up to n, as products beyond."""
    rng = np.random.default_rng(seed)
    orders = np.array([np.arange(n), *(rng.permutation(n) for _ in range(permutations))])

    def common_of(doses: list, grams: list, x: list, gram: np.ndarray | None) -> tuple[list, np.ndarray | None]:
        """The doses (x) or else the products, with those of further parts."""
        for d, m in zip(doses, grams, strict=True):
            if d is not None:
                x = [*x, np.frombuffer(d, np.uint8).reshape(-1, n)]
            if m is not None:
                gram = np.frombuffer(m, np.int64).reshape(n, n) + (0 if gram is None else gram)
            if x and (gram is not None or sum(map(len, x)) > n):
                rows = np.concatenate(x).astype(np.float64)
                x, gram = [], (rows.T @ rows).astype(np.int64) + (0 if gram is None else gram)
        return x, gram

    def tested(names: list, variants: np.ndarray, rare: np.ndarray, sums: np.ndarray, common: dict) -> pa.RecordBatch:
        collapsed = np.where(rare[:, None] > 1, sums > 0, sums).astype(np.float64)
        size = variants - rare + (rare > 0)
        t2 = np.empty(len(names))
        hits = np.empty(len(names), np.int64)

        def put(at, found: np.ndarray) -> None:
            t2[at] = found[:, 0]
            # what is equal but for rounding counts as reached
            hits[at] = (found[:, 1:] >= found[:, :1] - 1e-9 * np.maximum(1, found[:, :1])).sum(1)

        for at, (x, gram) in common.items():
            own = collapsed[at][None, :] if rare[at] else np.zeros((0, n))
            design = None if gram is not None else np.concatenate([*x, own]).T.astype(np.float64)
            put([at], hotelling(design, None if gram is None else gram + own.T @ own, n1, orders)[None, :])
        single = np.array([k for k in range(len(names)) if k not in common], np.int64)
        step = max(1, 2**21 // len(orders))
        for at in range(0, len(single), step):
            put(single[at : at + step], hotelling_single(collapsed[single[at : at + step]], n1, orders))
        d2 = n - size - 1
        f = np.where(d2 > 0, t2 * d2 / np.maximum(1, (n - 2) * size), np.nan)
        values, back = np.unique(np.stack([f, size], 1), axis=0, return_inverse=True)
        tails = np.array([f_tail(v, int(p), int(n - p - 1)) if n - p - 1 > 0 else np.nan for v, p in values.tolist()])
        columns = (names, variants, rare, t2, f, tails[back.reshape(-1)], (hits + 1) / (permutations + 1))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["group", "variants", "rare", "t2", "fStatistic", "pValue", "permutationPValue"])

    held = None  # the last group so far, which may go on
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).dictionary_encode()
        codes = keys.indices.to_numpy()
        firsts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
        names = keys.dictionary.take(pa.array(codes[firsts])).to_pylist()
        variants, rare = (np.add.reduceat(batch.column(k).to_numpy(), firsts) for k in (1, 2))
        sums = np.add.reduceat(np.frombuffer(b"".join(batch.column(3).to_pylist()), np.int32).reshape(-1, n), firsts, 0, dtype=np.int64)
        doses, grams = batch.column(4).to_pylist(), batch.column(5).to_pylist()
        goes_on = held is not None and held[0] == names[0]
        if goes_on:
            variants[0], rare[0], sums[0] = variants[0] + held[1], rare[0] + held[2], sums[0] + held[3]
        elif held is not None:
            yield tested([held[0]], np.array([held[1]]), np.array([held[2]]), held[3][None, :], {0: held[4]} if held[4] else {})
        common = {}
        for k in np.flatnonzero(variants > rare).tolist():
            rows = slice(firsts[k], firsts[k + 1] if k + 1 < len(firsts) else None)
            before = held[4] if k == 0 and goes_on and held[4] else ([], None)
            common[k] = common_of(doses[rows], grams[rows], *before)
        last = len(names) - 1
        held = (names[last], variants[last], rare[last], sums[last], common.pop(last, None))
        if last:
            yield tested(names[:last], variants[:last], rare[:last], sums[:last], common)
    if held is not None:
        yield tested([held[0]], np.array([held[1]]), np.array([held[2]]), held[3][None, :], {0: held[4]} if held[4] else {})


def cmc(df: DataFrame, group: str, phenotype: str | None = None, cases: list[str] | None = None, controls: list[str] | None = None, study: str = "", maf: float = 0.05, permutations: int = 100, seed: int = 1) -> DataFrame:
    """Rare-variant burden of each group (a column, such as a gene): Hotelling's T-square of the common variants' doses
    and one indicator of carrying any rare one (a single rare variant keeps its dose); p from F and from seeded
    permutations of the samples.

    Tasks sum up their variants by group, so a group's size in memory depends on the samples, not on its variants.
    """
    from .association import case_control

    chosen = metadata_of(df).first(study)
    one, two = case_control(chosen, phenotype, cases, controls)
    n1, n = len(one), len(one) + len(two)
    rows = df.select(F.col(group).cast("string").alias("group"), F.transform(G.genotypes(F.col("studies"), chosen.id, [*one, *two]), lambda g: F.coalesce(G.dosage(g), F.lit(0)).cast("byte")).alias("g"))
    parts = rows.where(F.col("group").isNotNull()).mapInArrow(lambda b: burden_parts(b, n, maf), "group string, variants long, rare long, sums binary, doses binary, gram binary")
    dealt = parts.repartition("group").sortWithinPartitions("group")
    return dealt.mapInArrow(lambda b: burden_tests(b, n1, n, permutations, seed), "group string, variants long, rare long, t2 double, fStatistic double, pValue double, permutationPValue double")
