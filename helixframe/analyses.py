"""Batch analyses: read a dataset, run one operator, write its result into a folder.

Results on variants become folders of TSV parts, written by the executors; results on samples or the whole set are
a few rows and become one JSON file.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import HelixError
from .functions import genotype as G
from .metadata import metadata_of
from .operators import association, family, stats
from .sources import variants as IO


@dataclass
class Analysis:
    """Input path, output folder and study (the first where none is named)."""

    path: str
    out_dir: str
    study: str = ""

    def run(self, spark: SparkSession) -> str:
        """Runs the analysis; returns the path of what it has written."""
        return self.execute(IO.load(spark, self.path))

    def execute(self, df: DataFrame) -> str:
        raise NotImplementedError

    def _target(self, name: str) -> str:
        return f"{self.out_dir.rstrip('/')}/{name}"

    def _write_tsv(self, df: DataFrame, extra: list, name: str) -> str:
        rows = IO.consequence_rows(df, extra).withColumnRenamed("chromosome", "#chromosome")
        IO.write_tsv(rows, self._target(name))
        return self._target(name)

    def _write_json(self, df: DataFrame, name: str) -> str:
        Path(self.out_dir).mkdir(parents=True, exist_ok=True)
        IO.write_json(df, self._target(name))
        return self._target(name)


@dataclass
class VariantStatsAnalysis(Analysis):
    """Statistics of a cohort for each variant and consequence."""

    cohort: str = "ALL"
    samples: list[str] = field(default_factory=list)
    missing_as_reference: bool = False

    def execute(self, df: DataFrame) -> str:
        name = metadata_of(df).first(self.study).id
        df = stats.variant_stats(df, self.cohort, self.samples or None, self.study, self.missing_as_reference)
        found = F.try_element_at(G.study_of(F.col("studies"), name)["stats"], F.lit(self.cohort))
        columns = df.select(found.alias("found")).schema["found"].dataType.names
        return self._write_tsv(df, [found[c].alias(f"{self.cohort}.{c}") for c in columns], "variant_stats.tsv")


@dataclass
class CohortStatsAnalysis(Analysis):
    """Statistics of the whole set, or of what a cohort or some samples carry."""

    cohort: str = ""
    samples: list[str] = field(default_factory=list)
    file_id: str | None = None

    def execute(self, df: DataFrame) -> str:
        study = metadata_of(df).first(self.study)
        if self.cohort and self.cohort not in study.cohorts:
            raise HelixError(f"Cohort '{self.cohort}' not found in study '{study.id}'")
        samples = self.samples or (study.cohorts[self.cohort] if self.cohort else None)
        return self._write_json(stats.variant_set_stats(df, self.study, self.file_id, samples), "cohort_stats.json")


@dataclass
class SampleStatsAnalysis(Analysis):
    """Statistics of listed samples, of a family, or of one individual's samples."""

    samples: list[str] = field(default_factory=list)
    family: str = ""
    individual: str = ""

    def execute(self, df: DataFrame) -> str:
        study = metadata_of(df).first(self.study)
        names = self.samples or [m.sample for m in study.family(self.family)] if self.samples or self.family else [study.member(self.individual).sample] if self.individual else None
        return self._write_json(stats.sample_stats(df, names, self.study), "sample_stats.json")


@dataclass
class GwasAnalysis(Analysis):
    """Case-control test for each variant and consequence."""

    method: str = association.FISHER
    phenotypes: tuple = ()
    samples: tuple = ()
    cohorts: tuple = ()
    mode: str = "TWO_SIDED"

    def execute(self, df: DataFrame) -> str:
        tested = association.gwas(df, self.study, self.method, self.phenotypes, self.samples, self.cohorts, self.mode)
        return self._write_tsv(tested, [c for c in ("chiSquare", "pValue", "oddRatio") if c in tested.columns], "gwas.tsv")


@dataclass
class TdtAnalysis(Analysis):
    """Transmission test for each variant and consequence."""

    phenotype: str = ""

    def execute(self, df: DataFrame) -> str:
        if not self.phenotype:
            raise HelixError.missing_param("phenotype")
        return self._write_tsv(family.tdt(df, self.phenotype, self.study), ["chiSquare", "pValue", "oddRatio", "freedomDegrees", "t1", "t2"], "tdt.tsv")
