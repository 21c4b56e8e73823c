"""The facade: one object with all operations of the library on a session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import metadata as M
from .functions import variant
from .operators import association, family, pairwise
from .operators import facet as faceting
from .operators import stats as statistics
from .sources import variants


class Helix:
    def __init__(self, spark: SparkSession):
        self.spark = spark

    def load(self, path: str) -> DataFrame:
        return variants.load(self.spark, path)

    def register(self, df: DataFrame, view: str | None = None) -> DataFrame:
        """Makes the accessor functions callable in SQL text for this DataFrame, and names a view of it."""
        variant.register(self.spark, df)
        if view:
            df.createOrReplaceTempView(view)
        return df

    metadata = staticmethod(M.metadata_of)
    set_metadata = staticmethod(M.attach)
    samples = staticmethod(M.samples)
    studies = staticmethod(M.studies)
    pedigrees = staticmethod(M.pedigrees)
    pedigree = staticmethod(M.pedigree)
    stats = staticmethod(statistics.variant_stats)
    global_stats = staticmethod(statistics.variant_set_stats)
    sample_stats = staticmethod(statistics.sample_stats)
    histogram = staticmethod(statistics.histogram)
    chrom_density = staticmethod(statistics.chrom_density)
    inbreeding = staticmethod(statistics.inbreeding)
    impute_sex = staticmethod(statistics.impute_sex)
    facet = staticmethod(faceting.facet)
    facet_tree = staticmethod(faceting.tree)
    hardy_weinberg = staticmethod(association.hardy_weinberg)
    chi_square = staticmethod(association.chi_square)
    fisher = staticmethod(association.fisher)
    gwas = staticmethod(association.gwas)
    linear_regression = staticmethod(association.linear_regression)
    logistic_regression = staticmethod(association.logistic_regression)
    tdt = staticmethod(family.tdt)
    mendel = staticmethod(family.mendelian_error)
    mode_of_inheritance = staticmethod(family.mode_of_inheritance)
    compound_heterozygote = staticmethod(family.compound_heterozygote)
    ibs = staticmethod(pairwise.ibs)
    ibd = staticmethod(pairwise.ibd)
    pca = staticmethod(pairwise.pca)
    cmc = staticmethod(pairwise.cmc)
