"""A small language for faceted counts and aggregations over variants.

    facet  := part ('>>' part)*                nesting; an aggregation only in last place
    part   := name                             categories
            | name '[' value (',' value)* ']'  some categories ('*' stands for all)
            | name '[' low '..' high ']:' step  ranges
            | fn '(' name ')'                  sum avg max min unique variance stddev percentile sumsq
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..errors import HelixError
from ..functions import variant as V

CATEGORY, RANGE, AGGREGATION = "CATEGORICAL", "RANGE", "AGGREGATION"
PERCENTILES = (0.1, 0.25, 0.5, 0.75, 0.9)
_AGGREGATES = {
    "sum": F.sum, "avg": F.avg, "max": F.max, "min": F.min, "variance": F.variance, "stddev": F.stddev, "unique": lambda c: F.array_sort(F.collect_set(c)),
    "percentile": lambda c: F.percentile(c, F.array(*map(F.lit, PERCENTILES))), "sumsq": lambda c: F.sum(c * c),
}
_LISTS = {"biotype": V.biotypes, "ct": V.consequence_types, "gene": V.genes, "ensemblGeneId": V.ensembl_genes}
_SUBSTITUTION = ("sift", "polyphen")


@dataclass(frozen=True)
class Part:
    kind: str
    name: str
    values: tuple[str, ...] = ()
    low: float = 0.0
    high: float = 0.0
    step: float = 1.0
    fn: str = ""

    @property
    def label(self) -> str:
        return f"{self.fn}({self.name})" if self.kind == AGGREGATION else f"{self.name}Range" if self.kind == RANGE else self.name


def parse(facet: str) -> list[Part]:
    """The parts of a facet string, outermost first."""
    parts = []
    for text in filter(None, (p.strip() for p in facet.split(">>"))):
        if m := re.fullmatch(r"(\w+)\((.+)\)", text):
            if m[1] not in _AGGREGATES:
                raise HelixError(f"Aggregation function unknown: {m[1]}")
            parts.append(Part(AGGREGATION, m[2], fn=m[1]))
        elif m := re.fullmatch(r"(.+)\[(.+)\.\.(.+)\]:(.+)", text):
            parts.append(Part(RANGE, m[1], low=float(m[2]), high=float(m[3]), step=float(m[4])))
        elif m := re.fullmatch(r"([^\[]+)\[(.*)\]", text):
            parts.append(Part(CATEGORY, m[1], tuple(v.strip() for v in m[2].split(","))))
        else:
            parts.append(Part(CATEGORY, text))
    if any(p.kind == AGGREGATION for p in parts[:-1]):
        raise HelixError(f"In nested facets, aggregations must be in last place: {facet}")
    if len({p.name for p in parts}) < len(parts):
        raise HelixError(f"In nested facets, repeating facets are not allowed: {facet}")
    return parts


def _derive(df: DataFrame, part: Part, name: str) -> DataFrame:
    """Adds the column that a part groups or aggregates by; lists give a row for each entry."""
    n = part.name
    if n in _LISTS:
        return df.withColumn(name, F.explode(_LISTS[n]("annotation")))
    if n == "ensemblTranscriptId":
        return df.withColumn(name, F.explode(F.filter(F.array_distinct(F.col("annotation.consequenceTypes.ensemblTranscriptId")), lambda x: x != "")))
    if n == "studies":
        return df.withColumn(name, F.explode("studies.studyId"))
    if n in ("gerp", "phylop", "phastCons"):
        return df.withColumn(name, V.conservation("annotation", n))
    if n in ("cadd_scaled", "cadd_raw"):
        return df.withColumn(name, V.functional("annotation", n))
    if n in _SUBSTITUTION:
        scores = F.transform(F.col("annotation.consequenceTypes"), lambda c: F.get(F.filter(c["proteinVariantAnnotation"]["substitutionScores"], lambda s: s["source"] == n), F.lit(0))["score"])
        return df.withColumn(name, F.explode(scores))
    if n.startswith("popFreq__"):
        _, study, population = n.split("__")
        return df.withColumn(name, V.population_frequency("annotation", study, population))
    if n.startswith("stats__"):
        _, study, cohort = n.split("__")
        return df.withColumn(name, F.try_element_at(V.study("studies", study)["stats"], F.lit(cohort))["maf"].cast("double"))
    return df.withColumn(name, F.col(n))


def facet(df: DataFrame, text: str) -> DataFrame:
    """Counts (and the last part's aggregate) for each combination of the parts, in order.

    Missing scores are left out of aggregates and ranges. The column count carries the facet string as metadata.
    """
    parts = parse(text)
    if not parts:
        return df.sparkSession.createDataFrame([], StructType())
    keys = [p.label for p in parts if p.kind != AGGREGATION]
    for k, part in enumerate(parts):
        held = f"_facet_{k}"
        df = _derive(df, part, held)
        if part.kind == RANGE:
            bucket = _bucket(F.col(held), part.step)
            df = df.withColumn(held, bucket).where(F.col(held).between(part.low, part.high))
        elif part.kind == CATEGORY and part.values and "*" not in part.values:
            df = df.where(F.col(held).cast("string").isin(list(part.values)))
    counted = F.count(F.lit(1)).alias("count", metadata={"facet": text})
    last = parts[-1]
    aggregates = [_AGGREGATES[last.fn](F.col(f"_facet_{len(parts) - 1}")).alias(last.label)] if last.kind == AGGREGATION else []
    by = [F.col(f"_facet_{k}").alias(p.label) for k, p in enumerate(parts) if p.kind != AGGREGATION]
    out = df.groupBy(*by).agg(*aggregates, counted) if by else df.agg(*aggregates, counted)
    return out.orderBy(*[F.col(f"`{k}`") for k in keys]) if keys else out


def _bucket(x: Column, step: float) -> Column:
    q = x / step
    return F.when(q >= 0, F.floor(q)).otherwise(F.ceil(q)) * F.lit(step)


@dataclass
class Bucket:
    value: str
    count: int = 0
    fields: list[Field] = field(default_factory=list)


@dataclass
class Field:
    name: str
    count: int = 0
    buckets: list[Bucket] = field(default_factory=list)
    aggregation: str = ""
    aggregation_values: list[float] = field(default_factory=list)
    start: float | None = None
    end: float | None = None
    step: float | None = None


def tree(result: DataFrame) -> Field:
    """A facet's result as nested buckets with running counts (read row by row; as many rows as there are buckets)."""
    parts = parse(result.schema["count"].metadata["facet"])

    def new(part: Part) -> Field:
        out = Field(part.name, aggregation=part.fn)
        if part.kind == RANGE:
            out.start, out.end, out.step = part.low, part.high, part.step
        return out

    root = new(parts[0])
    for row in result.toLocalIterator():
        here = root
        for k, part in enumerate(parts):
            here.count += row["count"]
            if part.kind == AGGREGATION:
                value = row[part.label]
                here.aggregation_values = list(value) if isinstance(value, list) else [value]
                break
            value = str(row[part.label])
            bucket = next((b for b in here.buckets[-1:] if b.value == value), None)
            if bucket is None:
                bucket = Bucket(value)
                here.buckets.append(bucket)
            bucket.count += row["count"]
            if k + 1 < len(parts):
                if not bucket.fields:
                    bucket.fields.append(new(parts[k + 1]))
                here = bucket.fields[0]
    return root
