"""Reading and writing variant datasets."""

from __future__ import annotations

import json
import logging
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType

from ..errors import HelixError
from ..functions import genotype as G
from ..functions import variant as V
from ..metadata import attach, metadata_of, read_metadata


def load(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet or Avro dataset with its metadata attached where the side file exists (a warning where not)."""
    name = path.rstrip("/")
    if name.endswith(("avro", "avro.gz")):
        try:
            df = spark.read.format("avro").load(path)
        except AnalysisException as error:
            if "avro" in str(error).lower() and "PATH_NOT_FOUND" not in str(error):
                raise HelixError.no_avro_source(path) from error
            raise
    elif name.endswith("parquet"):
        df = spark.read.parquet(path)
    else:
        raise HelixError.unsupported_format(path)
    found = read_metadata(path)
    if found is None:
        logging.getLogger(__name__).warning("no metadata beside %s", path)
        return df
    return attach(df, found) if "studies" in df.columns else df


def rewrite(spark: SparkSession, source: str, schema, target: str) -> None:
    """Reads Parquet with a given schema and writes it anew."""
    spark.read.schema(schema).parquet(source).write.parquet(target)


def cell(column: Column, kind) -> Column:
    """A value as one TSV cell: maps as k:v;k:v, arrays as a;b."""
    if isinstance(kind, MapType):
        return F.array_join(F.transform(F.map_entries(column), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string"))), ";")
    if isinstance(kind, ArrayType):
        return F.array_join(F.transform(column, lambda x: x.cast("string")), ";")
    return column.cast("string")


def as_cells(df: DataFrame) -> DataFrame:
    return df.select(*(cell(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields))


def write_tsv(df: DataFrame, path: str) -> None:
    """A folder of TSV parts with a header each, written by the executors."""
    as_cells(df).write.option("sep", "\t").option("header", True).option("emptyValue", "").csv(path)


def consequence_rows(df: DataFrame, extra: list[str]) -> DataFrame:
    """One row for each consequence: variant, gene, transcript, biotype, joined terms, and more columns."""
    rows = df.withColumn("_ct", F.explode("annotation.consequenceTypes"))
    return rows.select(
        "chromosome", "start", "reference", "alternate", F.col("annotation.id").alias("dbSNP"), F.col("_ct.geneName").alias("gene"), F.col("_ct.ensemblGeneId").alias("ensemblGeneId"),
        F.col("_ct.ensemblTranscriptId").alias("transcript"), F.col("_ct.biotype").alias("biotype"), F.array_join(F.col("_ct.sequenceOntologyTerms.name"), ",").alias("consequenceType"), *extra,
    )


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object for each row, in a local file; for results of a few rows."""
    Path(path).write_text(json.dumps([json.loads(r[0]) for r in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).toLocalIterator()], indent=2))


def vcf(df: DataFrame, study: str = "", file_id: str | None = None) -> DataFrame:
    """A VCF-like table: fixed columns, INFO as a map AF, AC, AN over called alleles with missing as reference, a column for each sample."""
    chosen = metadata_of(df).first(study)
    here = G.study_of(F.col("studies"), chosen.id)
    file = F.get(here["files"], F.lit(0)) if file_id is None else V.file("studies", file_id)
    dash = lambda name: F.when(F.col(name) == "", "-").otherwise(F.col(name))
    gts = F.transform(G.genotypes(F.col("studies"), chosen.id), lambda g: F.when(g.isin("./.", "?/?", "."), "0/0").otherwise(g))
    alleles = F.flatten(F.transform(gts, lambda g: F.split(g, "[/|]")))
    counts = F.transform(F.array(alleles), lambda a: F.struct(F.size(F.filter(a, lambda x: x == "1")).alias("ac"), F.size(F.filter(a, lambda x: x != ".")).alias("an")))
    info = F.get(F.transform(counts, lambda c: F.create_map(F.lit("AF"), F.coalesce(F.try_divide(c["ac"].cast("double"), c["an"]), F.lit(0.0)).cast("string"), F.lit("AC"), c["ac"].cast("string"), F.lit("AN"), c["an"].cast("string"))), F.lit(0))
    samples = [F.get(gts, F.lit(i)).alias(s) for i, s in enumerate(chosen.samples)]
    others = F.transform(here["secondaryAlternates"], lambda a: a["alternate"])
    return df.select(
        F.col("chromosome").alias("#CHROM"), F.col("start").alias("POS"), F.col("id").alias("ID"), dash("reference").alias("REF"), F.concat_ws(",", dash("alternate"), others).alias("ALT"),
        F.try_element_at(file["attributes"], F.lit("QUAL")).alias("QUAL"), F.try_element_at(file["attributes"], F.lit("FILTER")).alias("FILTER"), info.alias("INFO"), F.lit("GT").alias("FORMAT"), *samples,
    )


def vcf_header(df: DataFrame, study: str = "") -> list[str]:
    """Header lines for the fields that vcf() fills, ending with the names of its columns."""
    return [
        "##fileformat=VCFv4.2",
        '##INFO=<ID=AC,Number=A,Type=Integer,Description="Alternate alleles in called genotypes">',
        '##INFO=<ID=AF,Number=A,Type=Float,Description="Alternate allele frequency">',
        '##INFO=<ID=AN,Number=1,Type=Integer,Description="Alleles in called genotypes">',
        '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">',
        "\t".join(vcf(df, study).columns),
    ]


def write_vcf(df: DataFrame, path: str, study: str = "") -> None:
    """A folder of VCF text whose first part is the header: its parts in order of name are one VCF file."""
    table = vcf(df, study)
    info = F.concat_ws(";", F.transform(F.map_entries("INFO"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    cells = [F.coalesce((info if c == "INFO" else F.col(f"`{c}`").cast("string")), F.lit(".")) for c in table.columns]
    head = df.sparkSession.range(0, 1, 1, 1).select(F.explode(F.array(*map(F.lit, vcf_header(df, study)))).alias("value"))
    head.union(table.select(F.concat_ws("\t", *cells).alias("value"))).write.text(path)


def ped(df: DataFrame, study: str = "") -> list[str]:
    """Pedigree lines: family, sample, father, mother, sex code, phenotype."""
    code = {"MALE": "1", "FEMALE": "2"}
    return ["\t".join((m.family or m.sample, m.sample, m.father or "0", m.mother or "0", code.get(m.sex.upper(), "0"), m.phenotype or "-9")) for m in metadata_of(df).first(study).members]


def ped_genotypes(df: DataFrame, study: str = "") -> DataFrame:
    """sample and its allele pairs over all variants in order of chromosome and start, as PED's genotype part.

    One row holds a sample's genotypes over all variants: for exports of bounded regions only.
    """
    chosen = metadata_of(df).first(study)
    names = F.array(*map(F.lit, chosen.samples))
    allele = lambda a: F.when(a == "0", F.col("reference")).when(a == "1", F.col("alternate")).otherwise("0")
    pairs = F.transform(G.genotypes(F.col("studies"), chosen.id), lambda g: F.concat_ws(" ", F.transform(F.split(g, "[/|]"), allele)))
    long = df.select("chromosome", "start", F.posexplode(pairs).alias("i", "pair"))
    return long.groupBy(F.get(names, F.col("i")).alias("sample")).agg(F.array_sort(F.collect_list(F.struct("chromosome", "start", "pair"))).alias("g")).select("sample", F.array_join("g.pair", "\t").alias("genotypes"))


def map_rows(df: DataFrame) -> DataFrame:
    """MAP lines: chromosome, id, 0, start."""
    return df.select("chromosome", "id", F.lit(0).alias("distance"), "start")
