"""Operators as pipeline stages, and batch analyses with what they write."""

import json

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Bucketizer
from pyspark.sql import functions as F

from helixframe import analyses as A
from helixframe import transformers as X
from helixframe.errors import HelixError
from helixframe.operators import stats
from helixframe.plans import synthetic as S


@pytest.fixture(scope="module")
def df(spark):
    return S.variants(spark, "/root/testdata/sf0.001").cache()


def test_stages_equal_the_functions(df):
    rows = lambda x: sorted(map(str, x.collect()))
    assert rows(X.ChromDensity(chroms="3,4", step=50_000).transform(df)) == rows(stats.chrom_density(df, "3,4", 50_000))
    stage = X.Histogram(column="score")
    assert rows(stage.transform(df, {stage.step: 100.0})) == rows(stats.histogram(df, "score", 100.0))
    with pytest.raises(HelixError, match="column"):
        X.Histogram().transform(df)
    with pytest.raises(HelixError, match="no parameter 'steps'"):
        X.Histogram(steps=1)


@pytest.mark.parametrize("stage", [X.VariantSetStats(), X.SampleVariantStats(samples=S.NAMES[:2]), X.Facet(text="type"), X.HardyWeinberg(), X.ChiSquare(cases=S.CASES), X.Fisher(phenotype="P1"), X.Gwas(samples=(S.CASES, S.CONTROLS)), X.Tdt(phenotype="P1"), X.MendelianError(father=S.FATHER, mother=S.MOTHER, child=S.CHILD), X.ModeOfInheritance(family="F1", mode="recessive", phenotype="P1"), X.CompoundHeterozygote(father=S.FATHER, mother=S.MOTHER, child=S.CHILD), X.Ibs(samples=S.NAMES[:3]), X.Pca(k=2)], ids=lambda s: type(s).__name__)
def test_every_stage_runs(df, stage):
    assert stage.transform(df).limit(1).count() >= 0


def test_pipeline_is_saved_and_read(df, tmp_path):
    model = Pipeline(stages=[X.VariantStats(), X.InbreedingCoefficient(maf_threshold=0.1), Bucketizer(splits=[float("-inf"), 0.0, float("inf")], inputCol="F", outputCol="bucket")]).fit(df)
    model.write().save(f"{tmp_path}/model")
    again = PipelineModel.load(f"{tmp_path}/model").transform(df)
    assert again.count() == 17 and sorted(map(str, again.collect())) == sorted(map(str, model.transform(df).collect()))


def test_analyses(spark, df, tmp_path):
    out = str(tmp_path)
    rows = lambda path: spark.read.option("sep", "\t").option("header", True).csv(path)
    assert rows(A.VariantStatsAnalysis("", out).execute(df)).where("`ALL.alleleCount` >= 0").count() == 2 * df.count()
    gwas = rows(A.GwasAnalysis("", out, samples=(S.CASES, None)).execute(df))
    assert gwas.columns[0] == "#chromosome" and gwas.columns[-2:] == ["pValue", "oddRatio"] and gwas.count() == 2 * df.count()
    tdt = rows(A.TdtAnalysis("", out, phenotype="P1").execute(df))
    assert len(tdt.columns) == 16 and tdt.where(F.col("t1").isNotNull()).count() == 2 * df.count()
    cohort = json.load(open(A.CohortStatsAnalysis("", out, cohort="half").execute(df)))
    assert cohort[0]["numSamples"] == 9
    family = json.load(open(A.SampleStatsAnalysis("", out, family="F1").execute(df)))
    assert [r["sample"] for r in sorted(family, key=lambda r: r["sample"])] == S.NAMES[:4]
    with pytest.raises(HelixError, match="Cohort 'none'"):
        A.CohortStatsAnalysis("", out, cohort="none").execute(df)
