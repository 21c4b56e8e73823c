"""Genotype expressions: all JVM-side, on strings such as 0/0, 0|1, 1/2, ./. and haploid 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .tests import once

HOM_REF, HET, HOM_VAR = ("0/0", "0|0"), ("0/1", "1/0", "0|1", "1|0"), ("1/1", "1|1")


def alleles(gt: Column) -> Column:
    return F.split(F.replace(gt, F.lit("?"), F.lit(".")), r"[/|]")


def normalise(gt: Column) -> Column:
    """Unphased, alleles sorted, ? as missing."""
    return F.array_join(F.array_sort(alleles(gt)), "/")


def dosage(gt: Column) -> Column:
    """0, 1, 2 alternate alleles of a biallelic diploid genotype; null for all others."""
    return dosage_value(gt, 0, 1, 2)


def dosage_value(gt: Column, ref: int, het: int, var: int) -> Column:
    """One of three numbers by dosage; null for all other genotypes."""
    return F.when(gt.isin(*HOM_REF), ref).when(gt.isin(*HET), het).when(gt.isin(*HOM_VAR), var)


def is_missing(gt: Column) -> Column:
    return gt.isNull() | gt.contains(".") | gt.contains("?")


def has_main_alternate(gt: Column) -> Column:
    return F.array_contains(alleles(gt), "1")


def is_het(gt: Column) -> Column:
    return F.size(F.array_distinct(alleles(gt))) > 1


def is_hom(gt: Column) -> Column:
    return F.size(F.array_distinct(alleles(gt))) == 1


def multi_allelic(gt: Column) -> Column:
    return F.exists(alleles(gt), lambda a: F.coalesce(a.try_cast("int") > 1, F.lit(False)))


def is_snv(ref: Column, alt: Column) -> Column:
    return (F.length(ref) == 1) & (F.length(alt) == 1)


def is_transition(ref: Column, alt: Column) -> Column:
    return F.concat(F.upper(ref), F.upper(alt)).isin("AG", "GA", "CT", "TC")


def is_transversion(ref: Column, alt: Column) -> Column:
    pair = F.concat(F.upper(ref), F.upper(alt))
    return pair.isin("AC", "CA", "AT", "TA", "GC", "CG", "GT", "TG")


def study_of(studies: Column, study: str) -> Column:
    return F.get(F.filter(studies, lambda s: s["studyId"] == study), F.lit(0)) if study else F.get(studies, F.lit(0))


def genotype_at(studies: Column, study: str, index: int) -> Column:
    """Genotype of the sample at this position (the genotype is always the first format field)."""
    return F.get(F.get(study_of(studies, study)["samplesData"], F.lit(index)), F.lit(0))


def genotypes(studies: Column, study: str, indexes: list[int] | None = None) -> Column:
    """Genotypes of all samples, or of those at the given positions, in that order."""
    data = study_of(studies, study)["samplesData"]
    if indexes is None:
        return F.transform(data, lambda x: F.get(x, F.lit(0)))
    # the study is looked up once for each variant, not for each sample
    return once(data, lambda d: F.transform(F.array(*map(F.lit, indexes)), lambda i: F.get(F.get(d, i), F.lit(0))))


def allele_table(gts: Column) -> Column:
    """Struct of ref and alt allele counts over biallelic diploid genotypes."""
    # both counts in one number, so that each genotype is looked at once
    add = lambda acc, g: acc + F.coalesce(dosage_value(g, 2, (1 << 32) + 1, 2 << 32), F.lit(0))
    return once(F.aggregate(gts, F.lit(0).cast("long"), add), lambda n: F.struct(n.bitwiseAND((1 << 32) - 1).cast("int").alias("ref"), F.shiftright(n, 32).cast("int").alias("alt")))
