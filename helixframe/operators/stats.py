"""Per-variant, per-sample and whole-set statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import HelixError
from ..functions import genotype as G
from ..functions import variant as V
from ..functions.tests import once
from ..metadata import attach, metadata_of


def stats_struct(gts: Column, missing_as_reference: bool = False) -> Column:
    """Allele and genotype counts and frequencies of an array of genotypes.

    Texts are split and sorted once for each distinct genotype of a variant, not for each sample.
    """

    def clean(g: Column) -> Column:
        text = F.replace(g, F.lit("?"), F.lit("."))
        return G.normalise(F.replace(text, F.lit("."), F.lit("0")) if missing_as_reference else text)

    def entry(gts: Column, g: Column) -> Column:
        return F.struct(clean(g).alias("key"), (F.size(gts) - F.size(F.array_remove(gts, g))).alias("value"))

    def merged(entries: Column) -> Column:
        """Equal once they are clean: 0|1 and 1/0."""
        number = lambda k: F.aggregate(entries, F.lit(0), lambda n, e: n + F.when(e["key"] == k, e["value"]).otherwise(0))
        return F.map_from_entries(F.transform(F.sort_array(F.array_distinct(F.transform(entries, lambda e: e["key"]))), lambda k: F.struct(k.alias("key"), number(k).alias("value"))))

    def alleles(counts: Column) -> Column:
        """The genotypes with their number and how many alleles of each kind they have."""

        def of(e: Column) -> Column:
            kind = lambda x, a: F.size(x) - F.size(F.array_remove(x, a))
            return once(F.split(e["key"], "/"), lambda x: F.struct(e["value"].alias("times"), e["key"].contains(".").alias("gap"), F.size(x).alias("all"), kind(x, ".").alias("missing"), kind(x, "0").alias("ref"), kind(x, "1").alias("alt")))

        return F.transform(F.map_entries(counts), of)

    def base(counts: Column) -> Column:
        called = F.map_filter(counts, lambda k, _: ~k.contains("."))
        zero = F.struct(*(F.lit(0).alias(k) for k in ("n", "ref", "alt", "missing", "missing_gt")))

        def add(a: Column, e: Column) -> Column:
            t = e["times"]
            return F.struct(
                (a["n"] + t * (e["all"] - e["missing"])).alias("n"), (a["ref"] + t * e["ref"]).alias("ref"), (a["alt"] + t * e["alt"]).alias("alt"), (a["missing"] + t * e["missing"]).alias("missing"),
                (a["missing_gt"] + F.when(e["gap"], t).otherwise(0)).alias("missing_gt"),
            )

        return once(F.aggregate(alleles(counts), zero, add), lambda b: F.struct(b.alias("b"), counts.alias("counts"), called.alias("called")))

    def frequencies(x: Column) -> Column:
        called = F.aggregate(F.map_values(x["called"]), F.lit(0), lambda n, v: n + v)
        gfreq = once(F.greatest(called, F.lit(1)), lambda n: F.transform_values(x["called"], lambda k, v: v / n))
        rarest = lambda g: F.array_min(F.transform(F.map_entries(g), lambda e: F.struct(e["value"].alias("f"), e["key"].alias("k"))))
        freq = lambda k: F.when(x["b"]["n"] > 0, x["b"][k] / F.greatest(x["b"]["n"], F.lit(1))).otherwise(0.0)
        return once(gfreq, lambda g: F.struct(x["b"].alias("b"), x["counts"].alias("counts"), g.alias("gfreq"), rarest(g).alias("rarest"), freq("ref").alias("ref"), freq("alt").alias("alt")))

    def done(x: Column) -> Column:
        b = x["b"]
        return F.struct(
            b["n"].alias("alleleCount"), b["ref"].alias("refAlleleCount"), b["alt"].alias("altAlleleCount"), b["missing"].alias("missingAlleleCount"), b["missing_gt"].alias("missingGenotypeCount"),
            x["ref"].cast("float").alias("refAlleleFreq"), x["alt"].cast("float").alias("altAlleleFreq"), x["counts"].alias("genotypeCount"), F.transform_values(x["gfreq"], lambda k, v: v.cast("float")).alias("genotypeFreq"),
            F.when(b["alt"] <= b["ref"], "alt").otherwise("ref").alias("mafAllele"), F.least(x["ref"], x["alt"]).cast("float").alias("maf"), x["rarest"]["k"].alias("mgfGenotype"), x["rarest"]["f"].cast("float").alias("mgf"),
        )

    every = F.transform(gts, lambda g: F.coalesce(g, F.lit("./.")))
    counts = once(once(every, lambda x: F.transform(F.array_distinct(x), lambda g: entry(x, g))), merged)
    return once(once(once(counts, base), frequencies), done)


STATS_TYPE = "struct<alleleCount:int,refAlleleCount:int,altAlleleCount:int,missingAlleleCount:int,missingGenotypeCount:int,refAlleleFreq:float,altAlleleFreq:float,genotypeCount:map<string,int>,genotypeFreq:map<string,float>,mafAllele:string,maf:float,mgfGenotype:string,mgf:float>"


def variant_stats(df: DataFrame, cohort: str = "ALL", samples: list[str] | None = None, study: str = "", missing_as_reference: bool = False) -> DataFrame:
    """Adds studies[].stats[cohort] of one study; the other studies stay as they are.

    The cohort joins the study's cohorts in the metadata; a cohort of that name is replaced.
    """
    metadata = metadata_of(df)
    chosen = metadata.first(study)
    indexes = chosen.indexes(samples) if samples else None
    name = chosen.id
    chosen.cohorts[cohort] = list(samples or chosen.samples)

    def one(s: Column) -> Column:
        data = s["samplesData"]
        gts = F.transform(data, lambda x: F.get(x, F.lit(0))) if indexes is None else F.transform(F.array(*map(F.lit, indexes)), lambda i: F.get(F.get(data, i), F.lit(0)))
        entry = F.create_map(F.lit(cohort), stats_struct(gts, missing_as_reference).cast(STATS_TYPE))
        kept = F.map_filter(s["stats"], lambda k, _: k != cohort)
        return F.when(s["studyId"] == name, s.withField("stats", F.coalesce(F.map_concat(kept, entry), entry))).otherwise(s)

    return attach(df.withColumn("studies", F.transform("studies", one)), metadata)


def missing_bucket(x: Column) -> Column:
    return F.when(x < 5, "<5").when(x < 10, "<10").when(x < 15, "<15").when(x < 20, "<20").otherwise(">=20")


def _keyed(kind: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("key")))


def _map_of(counts: DataFrame, by: list[str], kinds: tuple[str, ...]) -> DataFrame:
    """Rows (by, kind, key, n) as one row for each by with a map column for each kind."""
    entries = [F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct(F.col("key").alias("key"), F.col("n").alias("value")))))).alias(k) for k in kinds]
    return counts.groupBy(*by).agg(*entries) if by else counts.agg(*entries)


def variant_set_stats(df: DataFrame, study: str = "", file_id: str | None = None, samples: list[str] | None = None) -> DataFrame:
    """One row on the whole set; with samples, of variants that one of them carries, with a file, of those in it."""
    metadata = metadata_of(df)
    chosen = metadata.first(study)
    here = G.study_of(F.col("studies"), chosen.id)
    if samples:
        hits = [G.genotype_at(F.col("studies"), chosen.id, i).rlike("1") for i in chosen.indexes(samples)]
        carried = hits[0]
        for h in hits[1:]:
            carried = carried | h
        df = df.where(carried)
    files = here["files"] if file_id is None else F.filter(here["files"], lambda f: f["fileId"] == file_id)
    if file_id is not None:
        df = df.where(F.size(files) > 0)
    base = df.select(
        "chromosome", "type", "reference", "alternate", V.biotypes("annotation").alias("biotypes"), V.consequence_types("annotation").alias("terms"),
        F.exists(files, lambda f: F.coalesce(F.try_element_at(f["attributes"], F.lit("FILTER")) == "PASS", F.lit(False))).alias("pass"),
        F.filter(F.transform(files, lambda f: F.try_element_at(f["attributes"], F.lit("QUAL")).try_cast("double")), lambda q: q.isNotNull()).alias("quals"),
    )
    snv = G.is_snv(F.col("reference"), F.col("alternate"))
    total = lambda f: F.aggregate("quals", F.lit(0.0), lambda a, q: a + f(q))
    one = base.agg(
        F.count("*").alias("numVariants"), F.count_if("pass").alias("numPass"), F.count_if(snv & G.is_transition(F.col("reference"), F.col("alternate"))).alias("_ti"), F.count_if(snv & G.is_transversion(F.col("reference"), F.col("alternate"))).alias("_tv"),
        F.sum(F.size("quals")).alias("_n"), F.sum(total(lambda q: q)).alias("_s"), F.sum(total(lambda q: q * q)).alias("_q"),
    )
    mean = F.try_divide(F.col("_s"), F.col("_n"))
    one = one.select(
        F.lit(len(samples or chosen.samples)).alias("numSamples"), "numVariants", "numPass", F.try_divide(F.col("_ti").cast("double"), F.col("_tv")).alias("tiTvRatio"), mean.cast("float").alias("meanQuality"),
        F.sqrt(F.greatest(F.try_divide(F.col("_q"), F.col("_n")) - mean * mean, F.lit(0.0))).cast("float").alias("stdDevQuality"),
    )
    kinds = ("typeCount", "biotypeCount", "consequenceTypeCount", "chromosomeCount")
    pairs = F.flatten(F.array(*(_keyed(kind, a) for kind, a in zip(kinds, (F.array("type"), F.col("biotypes"), F.col("terms"), F.array("chromosome")), strict=True))))
    counts = base.select(F.inline(pairs)).groupBy("kind", "key").agg(F.count("*").alias("n"))
    return one.crossJoin(_map_of(counts, [], kinds))  # two frames of one row each


SAMPLE_MAPS = ("chromosomeCount", "typeCount", "genotypeCount", "indelLength", "mendelianErrorCount", "consequenceTypeCount", "biotypeCount")


def sample_stats(df: DataFrame, samples: list[str] | None = None, study: str = "", file_id: str | None = None) -> DataFrame:
    """One row for each sample, over the variants that it carries (missing positions over all variants)."""
    from .family import mendelian_code

    metadata = metadata_of(df)
    chosen = metadata.first(study)
    names = samples or chosen.samples
    indexes = chosen.indexes(names)
    known = chosen.samples
    here = G.study_of(F.col("studies"), chosen.id)
    files = here["files"] if file_id is None else F.filter(here["files"], lambda f: f["fileId"] == file_id)
    first_file = F.get(files, F.lit(0))
    at = {n: i for i, n in enumerate(known)}
    # positions as arrays of literals (-1 for none): the plan's size doesn't grow with the samples
    members = [chosen.members[i] for i in indexes]
    literals = lambda values: F.array(*map(F.lit, values))
    who = F.arrays_zip(
        literals(names).alias("sample"), literals(indexes).alias("own"), literals([at.get(m.father, -1) for m in members]).alias("father"),
        literals([at.get(m.mother, -1) for m in members]).alias("mother"), literals([m.sex.upper() == "MALE" for m in members]).alias("male"),
    )

    def of_samples(data: Column) -> Column:
        gt_of = lambda i: F.get(F.get(data, i), F.lit(0))
        return F.transform(who, lambda w: F.struct(w["sample"].alias("sample"), gt_of(w["own"]).alias("gt"), gt_of(w["father"]).alias("father"), gt_of(w["mother"]).alias("mother"), w["male"].alias("male")))

    per = once(here["samplesData"], of_samples)
    long = df.select(
        "chromosome", "type", "length", "reference", "alternate", V.biotypes("annotation").alias("biotypes"), V.consequence_types("annotation").alias("terms"),
        (F.try_element_at(first_file["attributes"], F.lit("FILTER")) == "PASS").alias("pass"), F.try_element_at(first_file["attributes"], F.lit("QUAL")).try_cast("double").alias("qual"), F.inline(per),
    )
    carrier = F.coalesce(G.has_main_alternate(F.col("gt")), F.lit(False))
    long = long.withColumn("carrier", carrier)
    both = F.col("father").isNotNull() | F.col("mother").isNotNull()
    snv = G.is_snv(F.col("reference"), F.col("alternate"))
    c = F.col("carrier")
    base = long.groupBy("sample").agg(
        F.count_if(c).alias("numVariants"), F.count_if(c & F.coalesce(F.col("pass"), F.lit(False))).alias("numPass"), F.count_if(c & snv & G.is_transition(F.col("reference"), F.col("alternate"))).alias("_ti"),
        F.count_if(c & snv & G.is_transversion(F.col("reference"), F.col("alternate"))).alias("_tv"), F.avg(F.when(c, F.col("qual"))).alias("meanQuality"), F.stddev_pop(F.when(c, F.col("qual"))).alias("stdDevQuality"),
        F.count_if(F.coalesce(G.is_missing(F.col("gt")), F.lit(True))).alias("missingPositions"), F.count_if(c & G.is_het(F.col("gt"))).alias("_het"),
    )
    base = base.select("sample", "numVariants", "numPass", F.try_divide(F.col("_ti").cast("double"), F.col("_tv")).alias("tiTvRatio"), "meanQuality", "stdDevQuality", "missingPositions", F.try_divide(F.col("_het").cast("double"), F.col("numVariants")).alias("heterozygosityRate"))
    code = F.when(both, mendelian_code(F.col("father"), F.col("mother"), F.col("gt"), F.col("chromosome"), F.col("male")))
    some = lambda x: F.array(x)
    lists = (some(F.col("chromosome")), some(F.col("type")), some(G.normalise(F.col("gt"))), F.when(F.col("type") == "INDEL", some(missing_bucket(F.col("length")))).otherwise(F.array().cast("array<string>")), F.when(code > 0, some(code.cast("string"))).otherwise(F.array().cast("array<string>")), F.col("terms"), F.col("biotypes"))
    pairs = F.flatten(F.array(*(_keyed(kind, a) for kind, a in zip(SAMPLE_MAPS, lists, strict=True))))
    counts = long.where("carrier").select("sample", F.inline(pairs)).groupBy("sample", "kind", "key").agg(F.count("*").alias("n"))
    return base.join(_map_of(counts, ["sample"], SAMPLE_MAPS), "sample", "left")


def inbreeding(df: DataFrame, study: str = "", missing_as_hom_ref: bool = False, include_multi_allelic: bool = False, maf_threshold: float = 0.0, step: int = -1) -> DataFrame:
    """F of each sample, over all variants or in bins of start; needs variant_stats for cohort ALL.

    Expected homozygotes add 1 - 2 maf (1 - maf) for each variant over the threshold that the sample has a call for.
    """
    chosen = metadata_of(df).first(study)
    here = G.study_of(F.col("studies"), chosen.id)
    names = F.array(*map(F.lit, chosen.samples))
    by = [F.col("chromosome"), (F.floor(F.col("start") / step) * step).cast("int").alias("start")] if step > 0 else []

    def hom(gt: Column) -> Column:
        """Whether a call is homozygous, null for what does not count; plain genotypes are settled before any text is split."""
        call = F.when(gt.isin(*G.HOM_REF, *G.HOM_VAR), True).when(gt.isin(*G.HET), False).when(G.is_missing(gt), F.lit(True) if missing_as_hom_ref else F.lit(None))
        return (call if include_multi_allelic else call.when(G.multi_allelic(gt), F.lit(None))).otherwise(G.is_hom(gt))

    def calls(s: Column) -> Column:
        maf = F.least(s["all"]["refAlleleFreq"], s["all"]["altAlleleFreq"]).cast("double")
        of = lambda m: F.transform(s["data"], lambda x, i: F.struct(i.alias("i"), m.alias("maf"), hom(F.get(x, F.lit(0))).alias("hom")))
        return once(maf, lambda m: F.when(m > maf_threshold, of(m)))

    # all in one generator: a column of its own would be computed once more for each filter on it that moves below
    seen = once(once(here, lambda h: F.struct(F.try_element_at(h["stats"], F.lit("ALL")).alias("all"), h["samplesData"].alias("data"))), calls)
    long = df.select(*by, F.inline(seen)).where("hom IS NOT NULL")
    keys = ["chromosome", "start"] if step > 0 else []
    sums = long.groupBy(*keys, F.get(names, F.col("i")).alias("SampleId")).agg(F.count_if("hom").alias("ObservedHom"), F.sum(1 - 2 * F.col("maf") * (1 - F.col("maf"))).alias("ExpectedHom"), F.count("*").alias("GenotypesCount"))
    f = F.try_divide(F.col("ObservedHom") - F.col("ExpectedHom"), F.col("GenotypesCount") - F.col("ExpectedHom"))
    return sums.select(*keys, "SampleId", f.alias("F"), "ObservedHom", "ExpectedHom", "GenotypesCount")


def _region(text: str) -> tuple[str, int, int]:
    chromosome, span = text.split(":")
    a, b = span.split("-")
    return chromosome, int(a), int(b)


def impute_sex(
    df: DataFrame, study: str = "", lower: float = 0.2, upper: float = 0.8, chromosome_x: str = "X", include_pseudoautosomal: bool = False, par1: str = "X:60001-2699520", par2: str = "X:154931044-155260560",
    missing_as_hom_ref: bool = False, include_multi_allelic: bool = False, maf_threshold: float = 0.0, step: int = -1,
) -> DataFrame:
    """Inbreeding on chromosome X (outside the pseudo-autosomal regions) and the sex that F suggests."""
    kept = F.col("chromosome") == chromosome_x
    if not include_pseudoautosomal:
        (_, a1, b1), (_, a2, b2) = _region(par1), _region(par2)
        kept = kept & ((F.col("start") < a1) | F.col("start").between(b1, a2) | (F.col("start") > b2))
    found = inbreeding(df.where(kept), study, missing_as_hom_ref, include_multi_allelic, maf_threshold, step)
    return found.withColumn("ImputedSex", F.when(F.col("F") < lower, "FEMALE").when(F.col("F") > upper, "MALE").otherwise("UNDETERMINED"))


def histogram(df: DataFrame, column: str, step: float = 0.1) -> DataFrame:
    """Rows for each bucket of a numeric column; buckets end toward zero and keep the column's type."""
    from pyspark.sql.types import NumericType

    kind = df.schema[column].dataType
    if not isinstance(kind, NumericType):
        raise HelixError(f"Input column must be NumericType. Found {kind.simpleString()}")
    bucket = _truncated(F.col(column), step).cast(kind).alias(column)
    return df.where(F.col(column).isNotNull()).groupBy(bucket).count().orderBy(column)


def _truncated(x: Column, step: float) -> Column:
    q = x / step
    return F.when(q >= 0, F.floor(q)).otherwise(F.ceil(q)) * F.lit(step)


def chrom_density(df: DataFrame, chroms: str = "", step: int = 1_000_000) -> DataFrame:
    """Variants for each chromosome and bin of start; works on a stream as well (without the order)."""
    if chroms:
        df = df.where(F.col("chromosome").isin([c.strip() for c in chroms.split(",")]))
    position = (F.floor(F.col("start") / step) * step).cast("int").alias("position")
    counted = df.groupBy("chromosome", position).count()
    return counted if df.isStreaming else counted.orderBy("chromosome", "position")
