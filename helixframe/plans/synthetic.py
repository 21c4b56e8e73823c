"""A deterministic variant dataset over the part table, and the same as DuckDB SQL.

Every part is a variant; 17 samples s = 0 .. 16 have genotypes from integer arithmetic on the part's key and size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..metadata import Member, Metadata, Study, attach

STUDY, FILE, SAMPLES = "project@set:one", "f1.vcf.gz", 17
NAMES = [f"S{s:02d}" for s in range(SAMPLES)]
CASES, CONTROLS = NAMES[:8], NAMES[8:]
FATHER, MOTHER, CHILD = NAMES[0], NAMES[1], NAMES[2]


def metadata() -> Metadata:
    """Family F1 has the father S00 and the mother S01 of S02 (affected) and S03; samples 0 to 7 have phenotype P1."""
    members = [Member(n, "F1" if i < 4 else f"F{i}", FATHER if i in (2, 3) else "", MOTHER if i in (2, 3) else "", "MALE" if i % 2 == 0 else "FEMALE", "P1" if i < 8 else "P2") for i, n in enumerate(NAMES)]
    members[0].phenotype = members[1].phenotype = members[3].phenotype = "P0"
    return Metadata({STUDY: Study(STUDY, members, {"half": NAMES[::2]}, {FILE: NAMES})})


#: Bytes of the part file for a task, and the most tasks.
TASK_BYTES, MOST_TASKS = 256 << 10, 4096


def _dealt(parts: DataFrame) -> DataFrame:
    """The parts in tasks by the file's size: each has a few bytes there and some kilobytes as a variant, and the file's
    own splits would leave most cores idle."""
    size = int(parts._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    tasks = min(MOST_TASKS, -(-size // TASK_BYTES))
    return parts.repartition(tasks) if tasks > 1 else parts


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested variant rows, with metadata attached."""
    p = _dealt(spark.read.parquet(f"{sf_dir}/part.parquet"))
    key, size = F.col("p_partkey"), F.col("p_size")
    letter = lambda i: F.substr(F.lit("ACGT"), (1 + i % 4).cast("int"), F.lit(1))
    score = lambda value, source: F.struct(value.cast("double").alias("score"), F.lit(source).alias("source"), F.lit("").alias("description"))
    term = lambda k: F.struct(F.concat(F.lit("SO:"), k.cast("string")).alias("accession"), F.concat(F.lit("term_"), k.cast("string")).alias("name"))
    consequence = lambda gene, transcript, terms, sift: F.struct(
        gene.alias("geneName"), F.concat(F.lit("ENSG"), F.coalesce(gene, F.lit(""))).alias("ensemblGeneId"), transcript.alias("ensemblTranscriptId"), F.col("p_type").alias("biotype"), F.array(*terms).alias("sequenceOntologyTerms"),
        F.struct(F.array(score(sift, "sift"), score(1 - sift, "polyphen")).alias("substitutionScores")).alias("proteinVariantAnnotation"),
    )
    gts = F.transform(F.sequence(F.lit(0), F.lit(SAMPLES - 1)), lambda s: F.array(_genotype((key * 7 + s * 13 + size * s) % 10), (10 + (key + s) % 30).cast("string")))
    quality = (key * 3 % 100).cast("string")
    stats_type = "map<string,struct<alleleCount:int,refAlleleCount:int,altAlleleCount:int,missingAlleleCount:int,missingGenotypeCount:int,refAlleleFreq:float,altAlleleFreq:float,genotypeCount:map<string,int>,genotypeFreq:map<string,float>,mafAllele:string,maf:float,mgfGenotype:string,mgf:float>>"
    study = F.struct(
        F.lit(STUDY).alias("studyId"),
        F.array(F.struct(F.lit(FILE).alias("fileId"), F.create_map(F.lit("FILTER"), F.when(key % 5 == 0, "LowQD;LowGQ").otherwise("PASS"), F.lit("QUAL"), F.when(key % 9 == 0, ".").otherwise(quality), F.lit("DP"), size.cast("string")).alias("attributes"))).alias("files"),
        F.array().cast("array<struct<alternate:string>>").alias("secondaryAlternates"), F.array(F.lit("GT"), F.lit("DP")).alias("format"), gts.alias("samplesData"), F.create_map().cast(stats_type).alias("stats"),
    )
    annotation = F.struct(
        F.concat(F.lit("rs"), key.cast("string")).alias("id"),
        F.array(consequence(F.col("p_brand"), F.concat(F.lit("T"), key.cast("string")), [term(key % 7)], key % 11 / 10), consequence(F.when(key % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("G"), (key % 13).cast("string"))), F.concat(F.lit("U"), key.cast("string")), [term(key % 7), term(7 + key % 2)], key % 6 / 10)).alias("consequenceTypes"),
        F.filter(F.array(F.struct(F.lit("1kG").alias("study"), F.lit("ALL").alias("population"), (key % 100 / 100).cast("float").alias("altAlleleFreq")), F.struct(F.lit("GNOMAD").alias("study"), F.lit("AMR").alias("population"), (key % 50 / 64).cast("float").alias("altAlleleFreq"))), lambda x: (x["study"] == "1kG") | (key % 4 != 0)).alias("populationFrequencies"),
        F.filter(F.array(score(key % 40 - 20, "gerp"), score(key % 9, "phylop")), lambda x: (x["source"] == "gerp") | (key % 2 == 0)).alias("conservation"),
        F.array(score(size, "cadd_raw"), score(size * 2, "cadd_scaled")).alias("functionalScore"),
    )
    rows = p.select(
        F.concat(F.lit("v"), key.cast("string")).alias("id"), F.array().cast("array<string>").alias("names"), (1 + key % 22).cast("string").alias("chromosome"), (key * 1000 + size).cast("int").alias("start"), (key * 1000 + size).cast("int").alias("end"),
        letter(key).alias("reference"), letter(key + 1 + size % 3).alias("alternate"), F.lit("+").alias("strand"), F.lit(1).alias("length"), F.when(key % 8 == 0, "INDEL").otherwise("SNV").alias("type"), F.array(study).alias("studies"), annotation.alias("annotation"),
        F.col("p_brand").alias("gene"), F.col("p_type").alias("biotype"), F.col("p_retailprice").alias("score"),
    )
    return attach(rows, metadata())


def _genotype(g):
    return F.when(g <= 3, "0/0").when(g <= 6, "0/1").when(g <= 8, "1/1").otherwise("./.")


#: The same variants (v) and their long genotypes (l: variant, s, gt, d = alternate alleles or null) for DuckDB.
V_SQL = f"""WITH v AS (
  SELECT 'v' || p_partkey AS id, p_partkey AS k, p_size AS z, (1 + p_partkey % 22)::VARCHAR AS chromosome, (p_partkey * 1000 + p_size)::INTEGER AS start, substr('ACGT', (1 + p_partkey % 4)::INTEGER, 1) AS reference,
         substr('ACGT', (1 + (p_partkey + 1 + p_size % 3) % 4)::INTEGER, 1) AS alternate, CASE WHEN p_partkey % 8 = 0 THEN 'INDEL' ELSE 'SNV' END AS type, p_brand AS gene, p_type AS biotype, p_retailprice AS score,
         CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE (p_partkey * 3 % 100)::DOUBLE END AS qual, p_partkey % 5 <> 0 AS pass,
         CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'G' || (p_partkey % 13) END AS gene2
  FROM part),
l AS (SELECT v.*, s, CASE WHEN g <= 3 THEN '0/0' WHEN g <= 6 THEN '0/1' WHEN g <= 8 THEN '1/1' ELSE './.' END AS gt, CASE WHEN g <= 3 THEN 0 WHEN g <= 6 THEN 1 WHEN g <= 8 THEN 2 END AS d
      FROM (SELECT v.*, s, (k * 7 + s * 13 + z * s) % 10 AS g FROM v, range({SAMPLES}) t(s)) v)
"""
