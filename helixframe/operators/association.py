"""Association tests of cases against controls, Hardy-Weinberg, regressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import HelixError
from ..functions import genotype as G
from ..functions import tests as T
from ..metadata import Study, metadata_of

FISHER, CHI_SQUARE = "fisher-test", "chi-square-test"


def case_control(study: Study, phenotype: str | None = None, cases: list[str] | None = None, controls: list[str] | None = None) -> tuple[list[int], list[int]]:
    """Positions of cases and controls; a side that is not given (None) is the rest of the samples. Sides must hold someone."""
    if phenotype:
        cases = with_phenotype(study, phenotype)
        controls = [m.sample for m in study.members if m.phenotype != phenotype]
    elif not cases and not controls:
        raise HelixError.missing_param("phenotype or sample lists")
    one, two = (None if side is None else study.indexes(side) for side in (cases, controls))
    everyone = range(len(study.samples))
    one, two = one if one is not None else [i for i in everyone if i not in set(two)], two if two is not None else [i for i in everyone if i not in set(one)]
    if not one or not two:
        raise HelixError("Cases and controls must hold one sample each at least")
    return one, two


def with_phenotype(study: Study, phenotype: str) -> list[str]:
    found = [m.sample for m in study.members if m.phenotype == phenotype]
    if not found:
        raise HelixError(f"No sample of study '{study.id}' has phenotype '{phenotype}'")
    return found


def _table(study: Study, cases: list[int], controls: list[int]) -> Column:
    """a, b, c, d: reference alleles of cases and controls, alternate alleles of cases and controls."""
    one = G.allele_table(G.genotypes(F.col("studies"), study.id, cases))
    two = G.allele_table(G.genotypes(F.col("studies"), study.id, controls))
    both = F.struct(one.alias("x"), two.alias("y"))
    return F.get(F.transform(F.array(both), lambda t: F.struct(t["x"]["ref"].alias("a"), t["y"]["ref"].alias("b"), t["x"]["alt"].alias("c"), t["y"]["alt"].alias("d"))), F.lit(0))


def _chi(t: Column) -> Column:
    # the statistic and its p-value come from one lambda, each computed once
    of = lambda x: F.struct(x.alias("chiSquare"), T.chi_square_p(x).alias("pValue"), T.odds_ratio(t["a"], t["b"], t["c"], t["d"]).alias("oddRatio"))
    return T.once(T.chi_square(t["a"], t["b"], t["c"], t["d"]), of)


def _fisher(t: Column, mode: str) -> Column:
    return F.struct(T.fisher(t["a"], t["b"], t["c"], t["d"], mode).alias("pValue"), T.odds_ratio(t["a"], t["b"], t["c"], t["d"]).alias("oddRatio"))


def _tested(df: DataFrame, study: Study, sides, make) -> DataFrame:
    # the table is a lambda variable, so each test reads it once computed
    table = F.transform(F.array(_table(study, *sides)), make)
    return df.withColumn("_test", F.get(table, F.lit(0)))


def chi_square(df: DataFrame, study: str = "", phenotype: str | None = None, cases: list[str] | None = None, controls: list[str] | None = None) -> DataFrame:
    """Adds Chi_square__p_value__odd_ratio, an array of the three."""
    chosen = metadata_of(df).first(study)
    out = _tested(df, chosen, case_control(chosen, phenotype, cases, controls), _chi)
    return out.withColumn("Chi_square__p_value__odd_ratio", F.array("_test.chiSquare", "_test.pValue", "_test.oddRatio")).drop("_test")


def fisher(df: DataFrame, study: str = "", phenotype: str | None = None, cases: list[str] | None = None, controls: list[str] | None = None, mode: str = T.TWO_SIDED) -> DataFrame:
    """Adds p_value__odd_ratio, an array of the two."""
    chosen = metadata_of(df).first(study)
    out = _tested(df, chosen, case_control(chosen, phenotype, cases, controls), lambda t: _fisher(t, mode))
    return out.withColumn("p_value__odd_ratio", F.array("_test.pValue", "_test.oddRatio")).drop("_test")


def gwas(df: DataFrame, study: str = "", method: str = FISHER, phenotypes: tuple = (), samples: tuple = (), cohorts: tuple = (), mode: str = T.TWO_SIDED) -> DataFrame:
    """Adds the test's columns. Sides come from phenotypes, else sample lists, else cohorts; each is (first, second or None)."""
    chosen = metadata_of(df).first(study)
    pair = lambda x: (*x, None, None)[:2]
    if phenotypes:
        first, second = pair(phenotypes)
        of = lambda p: with_phenotype(chosen, p) if p else None
        sides = case_control(chosen, None, of(first), of(second))
    elif samples:
        sides = case_control(chosen, None, *pair(samples))
    elif cohorts:
        first, second = pair(cohorts)
        sides = case_control(chosen, None, chosen.cohorts[first] if first else None, chosen.cohorts[second] if second else None)
    else:
        raise HelixError.missing_param("phenotypes, samples or cohorts")
    if method.lower().startswith("fisher"):
        return _tested(df, chosen, sides, lambda t: _fisher(t, mode)).select("*", "_test.*").drop("_test")
    if method.lower().startswith("chi"):
        return _tested(df, chosen, sides, _chi).select("*", "_test.*").drop("_test")
    raise HelixError(f"Unknown GWAS method '{method}'")


def _number(doses: Column, dose: int) -> Column:
    return F.size(F.filter(doses, lambda x: x == dose))


def hardy_weinberg(df: DataFrame, study: str = "") -> DataFrame:
    """Adds HWE, the exact p-value of the study's genotype counts."""
    chosen = metadata_of(df).first(study)
    doses = F.transform(G.genotypes(F.col("studies"), chosen.id), G.dosage)
    counts = F.transform(F.array(doses), lambda d: F.struct(*(_number(d, k).alias(n) for k, n in enumerate(("aa", "ab", "bb")))))
    return df.withColumn("HWE", F.get(F.transform(counts, lambda c: T.hardy_weinberg(c["aa"], c["ab"], c["bb"])), F.lit(0)))


def linear_regression(df: DataFrame, dependent: str, independent: str, iterations: int = 10, regularisation: float = 0.3, elastic_net: float = 0.8):
    """A fitted linear model of one numeric column on another (or on a vector column)."""
    from pyspark.ml.regression import LinearRegression

    return LinearRegression(featuresCol="_features", labelCol="_label", maxIter=iterations, regParam=regularisation, elasticNetParam=elastic_net).fit(_design(df, dependent, independent))


def logistic_regression(df: DataFrame, dependent: str, independent: str, iterations: int = 10, regularisation: float = 0.3, elastic_net: float = 0.8):
    from pyspark.ml.classification import LogisticRegression

    return LogisticRegression(featuresCol="_features", labelCol="_label", maxIter=iterations, regParam=regularisation, elasticNetParam=elastic_net).fit(_design(df, dependent, independent))


def _design(df: DataFrame, dependent: str, independent: str) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=[independent], outputCol="_features", handleInvalid="skip").transform(df.withColumn("_label", F.col(dependent).cast("double"))).select("_features", "_label")
