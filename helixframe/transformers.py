"""The operators as stages of pyspark.ml pipelines: one Transformer for each, with the function's own parameters.

Parameters are ML Params of the same names and defaults as the function's arguments, so they can be set in the
constructor, copied, overridden in transform(df, {stage.param: value}) and saved with the pipeline.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame

from .errors import HelixError
from .operators import association, family, pairwise, stats
from .operators import facet as faceting


class Operator(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Applies ``operator`` to the DataFrame with this stage's parameters."""

    operator: Callable[..., DataFrame]

    def __init__(self, **values):
        super().__init__()
        for name, p in _arguments(type(self).operator).items():
            if p.default is not inspect.Parameter.empty:
                self._setDefault(**{name: p.default})
        self.set_params(**values)

    def set_params(self, **values) -> Operator:
        for name in values:
            if not self.hasParam(name):
                raise HelixError(f"{type(self).__name__} has no parameter '{name}'")
        return self._set(**values)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        for param in self.params:
            if not self.isDefined(param):
                raise HelixError.missing_param(param.name)
        return type(self).operator(dataset, **{param.name: self.getOrDefault(param) for param in self.params})


def _arguments(operator: Callable) -> dict[str, inspect.Parameter]:
    return dict(list(inspect.signature(operator).parameters.items())[1:])


def _stage(name: str, operator: Callable[..., DataFrame]) -> type[Operator]:
    params = {n: Param(Params._dummy(), n, f"as {operator.__name__}() takes it") for n in _arguments(operator)}
    return type(name, (Operator,), {"operator": staticmethod(operator), "__doc__": operator.__doc__, "__module__": __name__, **params})


VariantStats = _stage("VariantStats", stats.variant_stats)
VariantSetStats = _stage("VariantSetStats", stats.variant_set_stats)
SampleVariantStats = _stage("SampleVariantStats", stats.sample_stats)
Histogram = _stage("Histogram", stats.histogram)
ChromDensity = _stage("ChromDensity", stats.chrom_density)
InbreedingCoefficient = _stage("InbreedingCoefficient", stats.inbreeding)
ImputeSex = _stage("ImputeSex", stats.impute_sex)
Facet = _stage("Facet", faceting.facet)
HardyWeinberg = _stage("HardyWeinberg", association.hardy_weinberg)
ChiSquare = _stage("ChiSquare", association.chi_square)
Fisher = _stage("Fisher", association.fisher)
Gwas = _stage("Gwas", association.gwas)
Tdt = _stage("Tdt", family.tdt)
MendelianError = _stage("MendelianError", family.mendelian_error)
ModeOfInheritance = _stage("ModeOfInheritance", family.mode_of_inheritance)
CompoundHeterozygote = _stage("CompoundHeterozygote", family.compound_heterozygote)
Ibs = _stage("Ibs", pairwise.ibs)
Ibd = _stage("Ibd", pairwise.ibd)
Pca = _stage("Pca", pairwise.pca)
Cmc = _stage("Cmc", pairwise.cmc)
