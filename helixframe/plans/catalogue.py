"""Every registered query of the variant engine with its DuckDB form.

Results are flat or sorted arrays, doubles that come from sums or logarithms rounded to six places, so that both
engines give equal values.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import genotype as G
from ..functions import tests as T
from ..functions import variant as V
from ..metadata import metadata_of
from ..operators import association, facet, family, pairwise, stats
from ..sources import variants as IO
from .synthetic import CASES, CHILD, CONTROLS, FATHER, FILE, MOTHER, NAMES, STUDY, V_SQL, variants


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


CATALOGUE: dict[str, Query] = {}


def query(name: str, sql: str | None = None, view: bool = True):
    """Registers fn(df): df is the synthetic variants, or with view=False fn(spark, sf_dir)."""

    def add(fn):
        run = (lambda spark, sf_dir: fn(variants(spark, sf_dir))) if view else fn
        CATALOGUE[name] = Query(run, (V_SQL + sql if view else sql) if sql else None)
        return fn

    return add


def r6(column, name: str | None = None):
    c = F.col(column) if isinstance(column, str) else column
    out = F.round(c.cast("double"), 6)
    return out.alias(name or column) if name or isinstance(column, str) else out


def ln5(column, name: str):
    """Natural logarithm of a p-value to five places: compares small p-values by their relative error."""
    c = F.col(column) if isinstance(column, str) else column
    return (F.round(F.log(c.cast("double")), 5) + F.lit(0.0)).alias(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- scans, projections, filters -----------------------------------------------------------------------------------

@query("region_filter", "SELECT id, chromosome, start FROM v WHERE chromosome = '5' AND start > 100000 AND start < 1500000")
def _(df):
    return df.where((F.col("chromosome") == "5") & (F.col("start") > 100000) & (F.col("start") < 1500000)).select("id", "chromosome", "start")


@query("region_filter_sql", "SELECT id, start FROM v WHERE chromosome = '7' AND start BETWEEN 1 AND 900000")
def _(df):
    df.createOrReplaceTempView("variants_region")
    return df.sparkSession.sql("SELECT id, start FROM variants_region WHERE chromosome = '7' AND start BETWEEN 1 AND 900000")


@query("type_counts", "SELECT type, count(*) AS n FROM v GROUP BY type")
def _(df):
    return df.groupBy("type").agg(F.count("*").alias("n"))


@query("substitution_counts", "SELECT reference, alternate, count(*) AS n FROM v GROUP BY ALL")
def _(df):
    return df.groupBy("reference", "alternate").agg(F.count("*").alias("n")).orderBy(F.desc("n"))


@query("join_back", "SELECT v.id, c.gene FROM v JOIN (SELECT gene, min(id) AS id FROM v GROUP BY gene) c USING (id)".replace("c.gene", "c.gene AS found"))
def _(df):
    first = df.groupBy("gene").agg(F.min("id").alias("id")).withColumnRenamed("gene", "found")
    return df.select("id").join(first, "id").select("id", "found")


@query("vcf_projection", "SELECT chromosome AS chrom, start AS pos, id, reference AS ref, alternate AS alt, CASE WHEN k % 9 = 0 THEN '.' ELSE (k * 3 % 100)::VARCHAR END AS qual, CASE WHEN pass THEN 'PASS' ELSE 'LowQD;LowGQ' END AS filter, ac, 34 AS an, s00, s16 FROM v JOIN (SELECT id, sum(coalesce(d, 0))::BIGINT AS ac, max(CASE WHEN s = 0 THEN CASE WHEN gt = './.' THEN '0/0' ELSE gt END END) AS s00, max(CASE WHEN s = 16 THEN CASE WHEN gt = './.' THEN '0/0' ELSE gt END END) AS s16 FROM l GROUP BY id) USING (id)")
def _(df):
    t = IO.vcf(df)
    return t.select(F.col("#CHROM").alias("chrom"), F.col("POS").alias("pos"), F.col("ID").alias("id"), F.col("REF").alias("ref"), F.col("ALT").alias("alt"), F.col("QUAL").alias("qual"), F.col("FILTER").alias("filter"), F.col("INFO")["AC"].cast("long").alias("ac"), F.col("INFO")["AN"].cast("int").alias("an"), F.col("S00").alias("s00"), F.col("S16").alias("s16"))


@query("consequence_tsv_rows", "SELECT chromosome, start::VARCHAR AS start, gene, ct FROM (SELECT chromosome, start, gene, 'term_' || (k % 7) AS ct FROM v UNION ALL SELECT chromosome, start, gene2, 'term_' || (k % 7) || ',term_' || (7 + k % 2) FROM v)")
def _(df):
    return IO.as_cells(IO.consequence_rows(df, [])).select("chromosome", "start", "gene", F.col("consequenceType").alias("ct"))


@query("map_rows", "SELECT chromosome, id, 0 AS distance, start FROM v")
def _(df):
    return IO.map_rows(df)


# --- density, histograms, facets -----------------------------------------------------------------------------------

@query("chrom_density", "SELECT chromosome, (floor(start / 1000000) * 1000000)::INTEGER AS position, count(*) AS count FROM v GROUP BY ALL")
def _(df):
    return stats.chrom_density(df)


@query("chrom_density_subset", "SELECT chromosome, (floor(start / 50000) * 50000)::INTEGER AS position, count(*) AS count FROM v WHERE chromosome IN ('21', '22') GROUP BY ALL")
def _(df):
    return stats.chrom_density(df, "21,22", 50_000)


@query("histogram_double", "SELECT trunc(o_totalprice / 1000) * 1000 AS o_totalprice, count(*) AS count FROM orders GROUP BY 1", view=False)
def _(spark, sf_dir):
    return stats.histogram(_table(spark, sf_dir, "orders"), "o_totalprice", 1000)


@query("histogram_negative", "SELECT trunc(c_acctbal / 500) * 500 + 0.0 AS c_acctbal, count(*) AS count FROM customer GROUP BY 1", view=False)
def _(spark, sf_dir):
    return stats.histogram(_table(spark, sf_dir, "customer"), "c_acctbal", 500)


@query("histogram_int", "SELECT (trunc(p_size / 7) * 7)::INTEGER AS p_size, count(*) AS count FROM part GROUP BY 1", view=False)
def _(spark, sf_dir):
    return stats.histogram(_table(spark, sf_dir, "part"), "p_size", 7)


@query("bucketize_union", "SELECT bucket::DOUBLE AS bucket, source, count(*) AS n FROM (SELECT CASE WHEN score < 1000 THEN 0 WHEN score < 1500 THEN 1 ELSE 2 END AS bucket, 'all' AS source FROM v UNION ALL SELECT CASE WHEN score < 1000 THEN 0 WHEN score < 1500 THEN 1 ELSE 2 END, type FROM v) GROUP BY ALL")
def _(df):
    from pyspark.ml.feature import Bucketizer

    b = Bucketizer(splits=[float("-inf"), 1000.0, 1500.0, float("inf")], inputCol="score", outputCol="bucket")
    one, two = b.transform(df.select("score", F.lit("all").alias("source"))), b.transform(df.select("score", F.col("type").alias("source")))
    return one.unionByName(two).groupBy("bucket", "source").agg(F.count("*").alias("n"))


@query("sql_transformer_pipeline", "SELECT bucket::DOUBLE AS bucket, count(*) AS n FROM (SELECT CASE WHEN k % 100 < 50 THEN 0 ELSE 1 END AS bucket FROM v) GROUP BY 1")
def _(df):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import Bucketizer, SQLTransformer

    V.register(df.sparkSession, df)
    stages = [SQLTransformer(statement="SELECT round(population_frequency(annotation, '1kG', 'ALL'), 4) AS freq FROM __THIS__"), Bucketizer(splits=[0.0, 0.5, 1.0], inputCol="freq", outputCol="bucket")]
    return Pipeline(stages=stages).fit(df).transform(df).groupBy("bucket").agg(F.count("*").alias("n"))


def _facet(name: str, text: str, sql: str, columns: dict[str, str] | None = None):
    @query(name, sql)
    def _(df):
        out = facet.facet(df, text)
        kept = columns or {c: c for c in out.columns}
        return out.select(*(r6(F.col(f"`{a}`"), b) if dict(out.dtypes)[a] == "double" else F.col(f"`{a}`").alias(b) for a, b in kept.items()))


_facet("facet_simple", "type", "SELECT type, count(*) AS count FROM v GROUP BY 1")
_facet("facet_genes", "gene", "SELECT gene, count(*) AS count FROM (SELECT id, gene FROM v UNION SELECT id, gene2 FROM v WHERE gene2 <> '') GROUP BY 1")
_facet("facet_terms", "ct", "SELECT ct, count(*) AS count FROM (SELECT 'term_' || (k % 7) AS ct FROM v UNION ALL SELECT 'term_' || (7 + k % 2) FROM v) GROUP BY 1")
_facet("facet_include", "chromosome[21,22]", "SELECT chromosome, count(*) AS count FROM v WHERE chromosome IN ('21', '22') GROUP BY 1")
_facet("facet_range", "gerp[-10..10]:5", 'SELECT trunc((k % 40 - 20) / 5.0) * 5 + 0.0::DOUBLE AS "gerpRange", count(*) AS count FROM v WHERE trunc((k % 40 - 20) / 5.0) * 5 BETWEEN -10 AND 10 GROUP BY 1')
_facet("facet_popfreq_range", "popFreq__1kG__ALL[0..1]:0.25", 'SELECT floor((k % 100) / 25) * 0.25 AS "freqRange", count(*) AS count FROM v GROUP BY 1', {"popFreq__1kG__ALLRange": "freqRange", "count": "count"})
_facet("facet_nested2", "biotype>>type", "SELECT biotype, type, count(*) AS count FROM v GROUP BY 1, 2")
_facet("facet_nested3", "type>>chromosome>>cadd_raw[0..50]:10", 'SELECT type, chromosome, trunc(z / 10.0) * 10 AS "cadd_rawRange", count(*) AS count FROM v GROUP BY 1, 2, 3')
_facet("facet_nested_agg", "biotype>>avg(score)", 'SELECT biotype, round(avg(score), 6) AS "avg", count(*) AS count FROM v GROUP BY 1', {"biotype": "biotype", "avg(score)": "avg", "count": "count"})
for _fn, _sql in {"sum": "round(sum(score), 6)", "avg": "round(avg(score), 6)", "min": "min(score)", "max": "max(score)", "variance": "round(var_samp(score), 6)", "stddev": "round(stddev_samp(score), 6)", "sumsq": "round(sum(score * score), 6)"}.items():
    _facet(f"facet_agg_{_fn}", f"{_fn}(score)", f"SELECT round({_sql}, 3) AS value, count(*) AS count FROM v", {f"{_fn}(score)": "value", "count": "count"})
for _fn in ("sum", "avg", "min", "max", "variance", "stddev", "sumsq"):  # sums of doubles agree to three places
    CATALOGUE[f"facet_agg_{_fn}"] = Query(lambda s, d, q=CATALOGUE[f"facet_agg_{_fn}"].run: q(s, d).withColumn("value", F.round("value", 3)), CATALOGUE[f"facet_agg_{_fn}"].sql)


@query("facet_agg_percentile", "SELECT list_transform(quantile_cont(score, [0.1, 0.25, 0.5, 0.75, 0.9]), lambda x: round(x, 6)) AS value, count(*) AS count FROM v")
def _(df):
    return facet.facet(df, "percentile(score)").select(F.transform("percentile(score)", lambda x: F.round(x, 6)).alias("value"), "count")


@query("facet_agg_unique", "SELECT list_sort(list(DISTINCT chromosome)) AS value, count(*) AS count FROM v")
def _(df):
    return facet.facet(df, "unique(chromosome)").select(F.col("unique(chromosome)").alias("value"), "count")


# --- accessor functions --------------------------------------------------------------------------------------------

@query("revcomp", "SELECT id, translate(reverse(reference || 'n' || alternate), 'ACGTacgt', 'TGCATGCA') AS rc FROM v")
def _(df):
    return df.select("id", V.revcomp(F.concat("reference", F.lit("n"), "alternate")).alias("rc"))


@query("substitution_spectrum", "SELECT CASE WHEN reference IN ('C', 'T') THEN reference || '>' || alternate ELSE translate(reference || '>' || alternate, 'ACGT', 'TGCA') END AS change, count(*) AS n FROM v GROUP BY 1")
def _(df):
    pyrimidine = F.col("reference").isin("C", "T")
    side = lambda c: F.when(pyrimidine, F.col(c)).otherwise(V.revcomp(c))
    return df.groupBy(F.concat(side("reference"), F.lit(">"), side("alternate")).alias("change")).agg(F.count("*").alias("n"))


@query("genes", "SELECT id, list_sort(list_distinct(list_filter([gene, gene2], lambda x: x <> ''))) AS genes FROM v")
def _(df):
    return df.select("id", V.genes("annotation").alias("genes"))


@query("ensembl_genes", "SELECT id, list_sort(list_distinct(['ENSG' || gene, 'ENSG' || gene2])) AS genes FROM v")
def _(df):
    return df.select("id", V.ensembl_genes("annotation").alias("genes"))


@query("gene_membership_sql", "SELECT id FROM v WHERE gene = 'Brand#11' OR gene2 = 'G5'")
def _(df):
    V.register(df.sparkSession, df)
    df.createOrReplaceTempView("variants_genes")
    return df.sparkSession.sql("SELECT id FROM variants_genes WHERE array_contains(genes(annotation), 'Brand#11') OR array_contains(genes(annotation), 'G5')")


@query("biotypes", "SELECT id, [biotype] AS biotypes FROM v")
def _(df):
    return df.select("id", V.biotypes("annotation").alias("biotypes"))


@query("consequence_types", "SELECT id, list_sort(list_distinct(['term_' || (k % 7), 'term_' || (7 + k % 2)])) AS terms FROM v")
def _(df):
    return df.select("id", V.consequence_types("annotation").alias("terms"))


@query("consequence_types_by_gene", "SELECT id, CASE WHEN gene2 = 'G1' THEN list_sort(list_distinct(['term_' || (k % 7), 'term_' || (7 + k % 2)])) ELSE []::VARCHAR[] END AS terms FROM v")
def _(df):
    return df.select("id", V.consequence_types_by_gene("annotation", "G1").alias("terms"))


@query("protein_substitution", "SELECT id, [least(k % 11 / 10.0::DOUBLE, k % 6 / 10.0::DOUBLE), greatest(k % 11 / 10.0::DOUBLE, k % 6 / 10.0::DOUBLE)] AS sift FROM v")
def _(df):
    return df.select("id", V.protein_substitution("annotation", "sift").alias("sift"))


@query("functional", "SELECT id, z::DOUBLE AS raw, (2 * z)::DOUBLE AS scaled, NULL::DOUBLE AS none FROM v")
def _(df):
    return df.select("id", V.functional("annotation", "cadd_raw").alias("raw"), V.functional("annotation", "cadd_scaled").alias("scaled"), V.functional("annotation", "absent").alias("none"))


@query("conservation", "SELECT id, (k % 40 - 20)::DOUBLE AS gerp, CASE WHEN k % 2 = 0 THEN (k % 9)::DOUBLE END AS phylop FROM v")
def _(df):
    return df.select("id", V.conservation("annotation", "gerp").alias("gerp"), V.conservation("annotation", "phylop").alias("phylop"))


@query("population_frequency", "SELECT id, round((k % 100 / 100.0::DOUBLE)::FLOAT::DOUBLE, 6) AS kg, CASE WHEN k % 4 <> 0 THEN round((k % 50) / 64.0::DOUBLE, 6) ELSE 0 END AS gnomad FROM v")
def _(df):
    return df.select("id", r6(V.population_frequency("annotation", "1kG", "ALL"), "kg"), r6(V.population_frequency("annotation", "GNOMAD", "AMR"), "gnomad"))


@query("population_frequency_map", "SELECT id, p, f FROM (SELECT id, '1kG:ALL' AS p, round((k % 100 / 100.0::DOUBLE)::FLOAT::DOUBLE, 6) AS f FROM v UNION ALL SELECT id, 'GNOMAD:AMR', round((k % 50) / 64.0::DOUBLE, 6) FROM v WHERE k % 4 <> 0)")
def _(df):
    return df.select("id", F.explode(V.population_frequency_as_map("annotation")).alias("p", "f")).select("id", "p", r6("f"))


@query("population_filter_sql", "SELECT id FROM v WHERE k % 100 BETWEEN 10 AND 19")
def _(df):
    V.register(df.sparkSession, df)
    df.createOrReplaceTempView("variants_frequency")
    return df.sparkSession.sql("SELECT id FROM variants_frequency WHERE population_frequency(annotation, '1kG', 'ALL') BETWEEN 0.095 AND 0.195")


@query("study", f"SELECT id, '{STUDY}' AS study, NULL::VARCHAR AS none FROM v")
def _(df):
    return df.select("id", V.study("studies", STUDY)["studyId"].alias("study"), V.study("studies", "none")["studyId"].alias("none"))


@query("file_attribute", f"SELECT id, z::VARCHAR AS dp, '{FILE}' AS file FROM v")
def _(df):
    return df.select("id", V.file_attribute("studies", FILE, "DP").alias("dp"), V.file("studies", FILE)["fileId"].alias("file"))


@query("file_qual", "SELECT id, qual FROM v")
def _(df):
    return df.select("id", V.file_qual("studies", FILE).alias("qual"))


@query("file_filter", "SELECT id, CASE WHEN pass THEN ['PASS'] ELSE ['LowQD', 'LowGQ'] END AS filters FROM v")
def _(df):
    return df.select("id", V.file_filter("studies", FILE).alias("filters"))


@query("genotype", "SELECT id, max(CASE WHEN s = 3 THEN gt END) AS gt, max(CASE WHEN s = 3 THEN (10 + (k + s) % 30)::VARCHAR END) AS dp FROM l GROUP BY id")
def _(df):
    at = V.sample_index(metadata_of(df), NAMES[3])
    return df.select("id", V.genotype("studies", at).alias("gt"), V.sample_data_field("studies", at, "DP").alias("dp"))


@query("sample_data_sql", "SELECT id, [gt, (10 + (k + s) % 30)::VARCHAR] AS data, gt FROM l WHERE s = 5")
def _(df):
    V.register(df.sparkSession, df)
    df.createOrReplaceTempView("variants_samples")
    return df.sparkSession.sql(f"SELECT id, sample_data(studies, '{NAMES[5]}') AS data, genotype(studies, '{NAMES[5]}') AS gt FROM variants_samples")


@query("include", "SELECT id, 'rs' || k AS annotation_id, true AS no_scores, 1 AS studies FROM v")
def _(df):
    kept = V.include("annotation", df.schema["annotation"].dataType, "id,consequenceTypes")
    return df.select("id", kept["id"].alias("annotation_id"), kept["conservation"].isNull().alias("no_scores"), F.size(V.include_studies("studies", f"{STUDY},other")).alias("studies"))


@query("include_sql", f"SELECT id, 'rs' || k AS annotation_id, true AS no_scores, 1 AS studies, 0 AS others FROM v")
def _(df):
    V.register(df.sparkSession, df)
    df.createOrReplaceTempView("variants_include")
    return df.sparkSession.sql(f"SELECT id, include(annotation, 'id, consequenceTypes').id AS annotation_id, include(annotation, 'id').conservation IS NULL AS no_scores, size(include_studies(studies, '{STUDY}, other')) AS studies, size(include_studies(studies, 'other')) AS others FROM variants_include")


@query("rollup_and_top", "SELECT chromosome, type, n FROM (SELECT chromosome, type, count(*) AS n FROM v GROUP BY ROLLUP (chromosome, type)) ORDER BY n DESC, chromosome NULLS LAST, type NULLS LAST LIMIT 20")
def _(df):
    counted = df.rollup("chromosome", "type").agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), F.col("chromosome").asc_nulls_last(), F.col("type").asc_nulls_last()).limit(20)


@query("array_vectors", "SELECT id, [x, x + y, x + y + w] AS sums, [x, least(x, y), least(x, y, w)] AS low, [x, greatest(x, y), greatest(x, y, w)] AS high, list_transform([x, y, w], lambda e: least(5.0::DOUBLE, e)) AS bounded FROM (SELECT id, (k % 7)::DOUBLE AS x, (k % 11)::DOUBLE AS y, z::DOUBLE AS w FROM v)")
def _(df):
    from ..functions import vectors

    k = F.substring("id", 2, 20).cast("long")
    a = df.select("id", F.array((k % 7).cast("double"), (k % 11).cast("double"), V.functional("annotation", "cadd_raw")).alias("a"))
    return a.select("id", vectors.cumsum(F.col("a")).alias("sums"), vectors.cummin(F.col("a")).alias("low"), vectors.cummax(F.col("a")).alias("high"), vectors.pmin(5.0, F.col("a")).alias("bounded"))


# --- statistics ----------------------------------------------------------------------------------------------------

def _variant_stats(cohort: str, where: str, missing: bool) -> str:
    d = "coalesce(d, 0)" if missing else "d"
    return f"""SELECT id, (2 * count({d}))::INTEGER AS an, (2 * count({d}) - coalesce(sum({d}), 0))::INTEGER AS ref, coalesce(sum({d}), 0)::INTEGER AS alt, (2 * (count(*) - count({d})))::INTEGER AS missing,
        coalesce(round((sum({d}) / (2 * count({d})))::FLOAT::DOUBLE, 5), 0) AS freq, coalesce(round(least(sum({d}) / (2 * count({d})), 1 - sum({d}) / (2 * count({d})))::FLOAT::DOUBLE, 5), 0) AS maf, count(*) FILTER ({d} = 1) AS het FROM l WHERE {where} GROUP BY id"""


def _stats_columns(df: DataFrame, cohort: str) -> DataFrame:
    s = F.col("studies")[0]["stats"][cohort]
    return df.select("id", s["alleleCount"].alias("an"), s["refAlleleCount"].alias("ref"), s["altAlleleCount"].alias("alt"), s["missingAlleleCount"].alias("missing"), F.round(s["altAlleleFreq"].cast("double"), 5).alias("freq"), F.round(s["maf"].cast("double"), 5).alias("maf"), F.coalesce(F.try_element_at(s["genotypeCount"], F.lit("0/1")), F.lit(0)).cast("long").alias("het"))


@query("variant_stats", _variant_stats("ALL", "true", False))
def _(df):
    return _stats_columns(stats.variant_stats(df), "ALL")


@query("variant_stats_missing_ref", _variant_stats("ALL", "true", True))
def _(df):
    return _stats_columns(stats.variant_stats(df, missing_as_reference=True), "ALL")


@query("variant_stats_cohort", _variant_stats("few", "s IN (0, 2, 7, 12)", False))
def _(df):
    return _stats_columns(stats.variant_stats(df, "few", [NAMES[i] for i in (0, 2, 7, 12)]), "few")


_TI = "reference || alternate IN ('AG', 'GA', 'CT', 'TC')"


@query("global_stats", f"SELECT 17 AS samples, count(*) AS variants, count(*) FILTER (pass) AS pass, round((count(*) FILTER ({_TI}))::DOUBLE / count(*) FILTER (NOT ({_TI})), 6) AS titv, round(avg(qual), 3) AS mean, round(stddev_pop(qual), 3) AS sd FROM v")
def _(df):
    g = stats.variant_set_stats(df)
    return g.select(F.col("numSamples").alias("samples"), F.col("numVariants").alias("variants"), F.col("numPass").alias("pass"), r6("tiTvRatio", "titv"), F.round(F.col("meanQuality").cast("double"), 3).alias("mean"), F.round(F.col("stdDevQuality").cast("double"), 3).alias("sd"))


@query("global_stats_maps", "SELECT 'type' AS kind, type AS key, count(*) AS n FROM v GROUP BY 2 UNION ALL SELECT 'chromosome', chromosome, count(*) FROM v GROUP BY 2 UNION ALL SELECT 'term', t, count(*) FROM (SELECT 'term_' || (k % 7) AS t FROM v UNION ALL SELECT 'term_' || (7 + k % 2) FROM v) GROUP BY 2")
def _(df):
    g = stats.variant_set_stats(df)
    of = lambda kind, c: g.select(F.lit(kind).alias("kind"), F.explode(c).alias("key", "n"))
    return of("type", "typeCount").unionByName(of("chromosome", "chromosomeCount")).unionByName(of("term", "consequenceTypeCount"))


@query("global_stats_samples", "SELECT count(*) AS variants, count(*) FILTER (pass) AS pass FROM v WHERE id IN (SELECT id FROM l WHERE s IN (4, 9) AND gt LIKE '%1%')")
def _(df):
    g = stats.variant_set_stats(df, file_id=FILE, samples=[NAMES[4], NAMES[9]])
    return g.select(F.col("numVariants").alias("variants"), F.col("numPass").alias("pass"))


@query("sample_stats", f"""SELECT 'S' || lpad(s::VARCHAR, 2, '0') AS sample, count(*) FILTER (d > 0) AS variants, count(*) FILTER (d > 0 AND pass) AS pass, round((count(*) FILTER (d > 0 AND {_TI}))::DOUBLE / count(*) FILTER (d > 0 AND NOT ({_TI})), 6) AS titv,
        round(avg(qual) FILTER (d > 0), 3) AS mean, count(*) FILTER (d IS NULL) AS missing, round((count(*) FILTER (d = 1))::DOUBLE / count(*) FILTER (d > 0), 6) AS het FROM l GROUP BY s""")
def _(df):
    s = stats.sample_stats(df)
    return s.select("sample", F.col("numVariants").alias("variants"), F.col("numPass").alias("pass"), r6("tiTvRatio", "titv"), F.round("meanQuality", 3).alias("mean"), F.col("missingPositions").alias("missing"), r6("heterozygosityRate", "het"))


@query("sample_stats_maps", """SELECT 'S' || lpad(s::VARCHAR, 2, '0') AS sample, kind, key, count(*) AS n FROM (SELECT s, 'genotype' AS kind, gt AS key FROM l WHERE d > 0 UNION ALL SELECT s, 'type', type FROM l WHERE d > 0 UNION ALL SELECT s, 'indel', '<5' FROM l WHERE d > 0 AND type = 'INDEL') WHERE s IN (2, 5) GROUP BY ALL""")
def _(df):
    s = stats.sample_stats(df, [NAMES[2], NAMES[5]])
    of = lambda kind, c: s.select("sample", F.lit(kind).alias("kind"), F.explode(c).alias("key", "n"))
    return of("genotype", "genotypeCount").unionByName(of("type", "typeCount")).unionByName(of("indel", "indelLength"))


_MAF = "m AS (SELECT id, least(sum(d) / (2 * count(d)), 1 - sum(d) / (2 * count(d)))::FLOAT::DOUBLE AS maf FROM l GROUP BY id)"


def _inbreeding(by: str, where: str) -> str:
    return f""", {_MAF}, i AS (SELECT {by} s, (count(*) FILTER (d <> 1))::DOUBLE AS obs, sum(1 - 2 * maf * (1 - maf)) AS exp, count(*) AS n FROM l JOIN m USING (id) WHERE d IS NOT NULL AND {where} GROUP BY ALL)
        SELECT * EXCLUDE (s, obs, exp, n), 'S' || lpad(s::VARCHAR, 2, '0') AS sample, round((obs - exp) / (n - exp), 4) AS f, obs::BIGINT AS observed, round(exp, 2) AS expected, n FROM i"""


def _inbreeding_columns(df: DataFrame, *more) -> DataFrame:
    return df.select(*more, F.col("SampleId").alias("sample"), F.round("F", 4).alias("f"), F.col("ObservedHom").alias("observed"), F.round("ExpectedHom", 2).alias("expected"), F.col("GenotypesCount").alias("n"))


@query("inbreeding", _inbreeding("", "maf > 0.1"))
def _(df):
    return _inbreeding_columns(stats.inbreeding(stats.variant_stats(df), maf_threshold=0.1))


@query("inbreeding_step", _inbreeding("chromosome, (floor(start / 5000000) * 5000000)::INTEGER AS start,", "maf > 0"))
def _(df):
    return _inbreeding_columns(stats.inbreeding(stats.variant_stats(df), step=5_000_000), "chromosome", "start")


@query("impute_sex", f", {_MAF}, i AS (SELECT s, (count(*) FILTER (d <> 1))::DOUBLE AS obs, sum(1 - 2 * maf * (1 - maf)) AS exp, count(*) AS n FROM l JOIN m USING (id) WHERE d IS NOT NULL AND maf > 0 AND chromosome = '22' GROUP BY s) SELECT 'S' || lpad(s::VARCHAR, 2, '0') AS sample, CASE WHEN (obs - exp) / (n - exp) < 0.2 THEN 'FEMALE' WHEN (obs - exp) / (n - exp) > 0.8 THEN 'MALE' ELSE 'UNDETERMINED' END AS sex FROM i")
def _(df):
    return stats.impute_sex(stats.variant_stats(df), chromosome_x="22", include_pseudoautosomal=True).select(F.col("SampleId").alias("sample"), F.col("ImputedSex").alias("sex"))


@query("impute_sex_without_par", f", {_MAF}, i AS (SELECT s, (count(*) FILTER (d <> 1))::DOUBLE AS obs, sum(1 - 2 * maf * (1 - maf)) AS exp, count(*) AS n FROM l JOIN m USING (id) WHERE d IS NOT NULL AND maf > 0 AND chromosome = '22' AND (start < 60001 OR start BETWEEN 300000 AND 1200000 OR start > 1500000) GROUP BY s) SELECT 'S' || lpad(s::VARCHAR, 2, '0') AS sample, round((obs - exp) / (n - exp), 4) AS f, n, CASE WHEN (obs - exp) / (n - exp) < 0.2 THEN 'FEMALE' WHEN (obs - exp) / (n - exp) > 0.8 THEN 'MALE' ELSE 'UNDETERMINED' END AS sex FROM i")
def _(df):
    from ..metadata import attach

    found = stats.impute_sex(attach(stats.variant_stats(df).where("chromosome = '22'").withColumn("chromosome", F.lit("X")), metadata_of(df)), par1="X:60001-300000", par2="X:1200000-1500000")
    return found.select(F.col("SampleId").alias("sample"), F.round("F", 4).alias("f"), F.col("GenotypesCount").alias("n"), F.col("ImputedSex").alias("sex"))


# --- association ---------------------------------------------------------------------------------------------------

_ABCD = "t AS (SELECT id, coalesce(sum(2 - d) FILTER (s < 8), 0)::DOUBLE AS a, coalesce(sum(2 - d) FILTER (s >= 8), 0)::DOUBLE AS b, coalesce(sum(d) FILTER (s < 8), 0)::DOUBLE AS c, coalesce(sum(d) FILTER (s >= 8), 0)::DOUBLE AS d FROM l GROUP BY id)"
_CHI = "(a + b + c + d) * (a * d - b * c) * (a * d - b * c) / ((a + b) * (c + d) * (a + c) * (b + d))"
_OR = "CASE WHEN b * c > 0 THEN round(a * d / (b * c), 6) WHEN a * d > 0 THEN 'inf'::DOUBLE ELSE NULL END"
_P = "CASE WHEN x IS NULL THEN NULL ELSE round(ln(CASE WHEN sqrt(x / 2) < 2.5 THEN 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(60), lambda n: power(-1, n) * exp((2 * n + 1) * ln(greatest(sqrt(x / 2), 1e-300)) - lgamma(n + 1)) / (2 * n + 1))) ELSE exp(-x / 2) / (sqrt(pi()) * (sqrt(x / 2) + list_reduce([0.0::DOUBLE] || list_transform(range(60, 0, -1), lambda k: k::DOUBLE), lambda f, k: (k / 2) / (sqrt(x / 2) + f)))) END), 5) + 0.0 END"


def _no_nan(c):
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


@query("chi_square", f", {_ABCD}, u AS (SELECT id, CASE WHEN (a + b) * (c + d) * (a + c) * (b + d) > 0 THEN {_CHI} END AS x, {_OR} AS odds FROM t) SELECT id, round(x, 6) AS chi, {_P} AS ln_p, odds FROM u")
def _(df):
    a = "Chi_square__p_value__odd_ratio"
    out = association.chi_square(df, cases=CASES, controls=CONTROLS)
    return out.select("id", r6(_no_nan(F.col(a)[0]), "chi"), ln5(_no_nan(F.col(a)[1]), "ln_p"), r6(_no_nan(F.col(a)[2]), "odds"))


@query("gwas_chi", f", {_ABCD}, u AS (SELECT id, CASE WHEN (a + b) * (c + d) * (a + c) * (b + d) > 0 THEN {_CHI} END AS x FROM t) SELECT id, round(x, 6) AS chi FROM u")
def _(df):
    return association.gwas(df, method=association.CHI_SQUARE, samples=(CASES, CONTROLS)).select("id", r6(_no_nan(F.col("chiSquare")), "chi"))


def _sides(first: str, second: str) -> str:
    sums = ", ".join(f"coalesce(sum({v}) FILTER ({w}), 0)::DOUBLE AS {n}" for n, v, w in (("a", "2 - d", first), ("b", "2 - d", second), ("c", "d", first), ("d", "d", second)))
    return f", t AS (SELECT id, {sums} FROM l GROUP BY id), u AS (SELECT id, CASE WHEN (a + b) * (c + d) * (a + c) * (b + d) > 0 THEN {_CHI} END AS x FROM t) SELECT id, round(x, 6) AS chi, {_P} AS ln_p FROM u"


@query("gwas_phenotype", _sides("s = 2 OR s BETWEEN 4 AND 7", "s >= 8"))
def _(df):
    return association.gwas(df, method=association.CHI_SQUARE, phenotypes=("P1", "P2")).select("id", r6(_no_nan(F.col("chiSquare")), "chi"), ln5(_no_nan(F.col("pValue")), "ln_p"))


@query("gwas_cohort", _sides("s % 2 = 0", "s % 2 = 1"))
def _(df):
    return association.gwas(df, method=association.CHI_SQUARE, cohorts=("half", None)).select("id", r6(_no_nan(F.col("chiSquare")), "chi"), ln5(_no_nan(F.col("pValue")), "ln_p"))


@query("linear_regression", "SELECT round(regr_slope(score, z::DOUBLE), 6) AS slope, round(regr_intercept(score, z::DOUBLE), 4) AS intercept FROM v")
def _(df):
    numbers = df.select("score", V.functional("annotation", "cadd_raw").alias("z"))
    model = association.linear_regression(numbers, "score", "z", iterations=100, regularisation=0.0, elastic_net=0.0)
    return df.sparkSession.range(1).select(F.round(F.lit(float(model.coefficients[0])), 6).alias("slope"), F.round(F.lit(float(model.intercept)), 4).alias("intercept"))


@query("logistic_regression", ", c AS (SELECT type = 'INDEL' AS x, count(*) FILTER (pass) / count(*) FILTER (NOT pass) AS odds FROM v GROUP BY 1) SELECT round(ln(max(odds) FILTER (x)) - ln(max(odds) FILTER (NOT x)), 3) AS slope, round(ln(max(odds) FILTER (NOT x)), 3) AS intercept FROM c")
def _(df):
    """With one indicator the maximum of likelihood is a difference of log-odds."""
    passed = F.array_contains(V.file_filter("studies", FILE), "PASS").cast("double")
    model = association.logistic_regression(df.select(passed.alias("y"), (F.col("type") == "INDEL").cast("double").alias("x")), "y", "x", iterations=200, regularisation=0.0, elastic_net=0.0)
    return df.sparkSession.range(1).select(F.round(F.lit(float(model.coefficients[0])), 3).alias("slope"), F.round(F.lit(float(model.intercept)), 3).alias("intercept"))


def _fisher(low: str, high: str, keep: str) -> str:
    logp = lambda x: f"lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1) - lgamma({x} + 1) - lgamma(a + b - {x} + 1) - lgamma(a + c - {x} + 1) - lgamma(d - a + {x} + 1)"
    return f", {_ABCD} SELECT id, round(ln(least(1, list_sum(list_transform(range(({low})::BIGINT, ({high})::BIGINT + 1), lambda x: CASE WHEN {keep.format(logp=logp('x'), seen=logp('a'))} THEN exp({logp('x')}) ELSE 0 END)))), 5) + 0.0 AS ln_p FROM t"


@query("fisher", _fisher("greatest(0, a - d)", "least(a + b, a + c)", "{logp} <= {seen} + 1e-9"))
def _(df):
    return association.fisher(df, cases=CASES, controls=CONTROLS).select("id", ln5(F.col("p_value__odd_ratio")[0], "ln_p"))


@query("fisher_less", _fisher("greatest(0, a - d)", "a", "true"))
def _(df):
    return association.fisher(df, cases=CASES, controls=CONTROLS, mode=T.LESS).select("id", ln5(F.col("p_value__odd_ratio")[0], "ln_p"))


@query("fisher_greater", _fisher("a", "least(a + b, a + c)", "true"))
def _(df):
    return association.fisher(df, cases=CASES, controls=CONTROLS, mode=T.GREATER).select("id", ln5(F.col("p_value__odd_ratio")[0], "ln_p"))


@query("gwas_fisher_complement", _fisher("greatest(0, a - d)", "least(a + b, a + c)", "{logp} <= {seen} + 1e-9"))
def _(df):
    return association.gwas(df, samples=(CASES, None)).select("id", ln5("pValue", "ln_p"))


@query("hwe", """, c AS (SELECT id, count(*) FILTER (d = 0) AS aa, count(*) FILTER (d = 1) AS ab, count(*) FILTER (d = 2) AS bb FROM l GROUP BY id),
  e AS (SELECT *, 2 * least(aa, bb) + ab AS rare, aa + ab + bb AS n FROM c),
  h AS (SELECT id, ab, rare, n, unnest(range(rare % 2, rare + 1, 2)) AS h FROM e),
  w AS (SELECT id, ab, h, h * ln(2) - lgamma(h + 1) - lgamma((rare - h) / 2 + 1) - lgamma((2 * n - rare - h) / 2 + 1) AS lp FROM h),
  z AS (SELECT *, max(lp) OVER (PARTITION BY id) AS top, max(CASE WHEN h = ab THEN lp END) OVER (PARTITION BY id) AS seen FROM w)
  SELECT id, round(ln(least(1, sum(CASE WHEN lp <= seen + 1e-9 THEN exp(lp - top) ELSE 0 END) / sum(exp(lp - top)))), 5) + 0.0 AS ln_hwe FROM z GROUP BY id""")
def _(df):
    return association.hardy_weinberg(df).select("id", ln5("HWE", "ln_hwe"))


_PV = "p AS (SELECT k, round(((k * 7919) % 1000) / 1000.0::DOUBLE, 3) AS p FROM v), n AS (SELECT *, rank() OVER (ORDER BY p) AS lo, count(*) OVER (ORDER BY p) AS hi, count(*) OVER () AS m FROM p)"


def _p_values(df: DataFrame, method: str) -> DataFrame:
    base = df.select(F.substring("id", 2, 20).cast("long").alias("k")).withColumn("p", F.round((F.col("k") * 7919) % 1000 / 1000, 3))
    return T.adjust(base, "p", method).select("k", r6("adjusted"))


for _method, _value in {
    "bonferroni": "least(1, p * m)",
    "bh": "least(1, min(m * p / hi) OVER (ORDER BY p DESC))",
    "by": "least(1, min((SELECT list_sum(list_transform(range(1, (SELECT count(*) FROM p) + 1), lambda i: 1.0::DOUBLE / i))) * m * p / hi) OVER (ORDER BY p DESC))",
    "hochberg": "least(1, min((m - hi + 1) * p) OVER (ORDER BY p DESC))",
    "holm": "least(1, max((m - lo + 1) * p) OVER (ORDER BY p))",
}.items():
    query(f"p_adjust_{_method}", f", {_PV} SELECT k, round({_value}, 6) AS adjusted FROM n")(lambda df, m=_method: _p_values(df, m))


# --- families ------------------------------------------------------------------------------------------------------

_TRIO = "t AS (SELECT id, chromosome, start, reference, alternate, gene, gene2, max(CASE WHEN s = 0 THEN d END) AS f, max(CASE WHEN s = 1 THEN d END) AS m, max(CASE WHEN s = 2 THEN d END) AS c, max(CASE WHEN s = 3 THEN d END) AS b FROM l GROUP BY ALL)"
_CODE = "CASE WHEN f = 0 AND m = 0 AND c = 1 THEN 1 WHEN f = 2 AND m = 2 AND c = 1 THEN 2 WHEN f = 2 AND m = 2 AND c = 0 THEN 5 WHEN f = 0 AND m = 0 AND c = 2 THEN 8 WHEN f = 2 AND c = 0 THEN 3 WHEN m = 2 AND c = 0 THEN 4 WHEN f = 0 AND c = 2 THEN 6 WHEN m = 0 AND c = 2 THEN 7 ELSE 0 END"


@query("mendel", f", {_TRIO} SELECT id, {_CODE} AS code FROM t")
def _(df):
    return family.mendelian_error(df, FATHER, MOTHER, CHILD).select("id", F.col("mendelianError").alias("code"))


@query("tdt", f""", {_TRIO}, x AS (SELECT id, (f = 1)::INTEGER + (m = 1)::INTEGER AS het, CASE WHEN f = 1 AND m = 1 THEN c WHEN f = 1 THEN c - m // 2 ELSE c - f // 2 END AS alt, {_CODE} AS code, f IS NOT NULL AND m IS NOT NULL AND c IS NOT NULL AS called FROM t),
  y AS (SELECT id, CASE WHEN called AND code = 0 AND het > 0 THEN het - alt ELSE 0 END AS t1, CASE WHEN called AND code = 0 AND het > 0 THEN alt ELSE 0 END AS t2 FROM x)
  SELECT id, t1::INTEGER AS t1, t2::INTEGER AS t2, CASE WHEN t1 + t2 > 0 THEN round((t1 - t2) * (t1 - t2) / (t1 + t2)::DOUBLE, 6) ELSE -1 END AS chi, CASE WHEN t2 > 0 THEN round(t1 / t2::DOUBLE, 6) ELSE -1 END AS odds FROM y""")
def _(df):
    return family.tdt(df, "P1").select("id", "t1", "t2", r6("chiSquare", "chi"), r6("oddRatio", "odds"))


#: Children, fathers, mothers and whether the child is a son, where three couples have five affected children.
_TRIOS = ((2, 0, 1, True), (3, 0, 1, False), (6, 4, 5, True), (7, 4, 5, False), (10, 8, 9, True))


def _three_couples(df: DataFrame) -> DataFrame:
    """The variants with _TRIOS as their pedigrees, and chromosomes 3 and 4 as X."""
    from ..metadata import Member, Metadata, Study, attach

    parents = {c: (f, m, male) for c, f, m, male in _TRIOS}
    members = [Member(n, f"F{i}", *(NAMES[x] for x in parents[i][:2]), "MALE" if parents[i][2] else "FEMALE", "P1") if i in parents else Member(n, f"F{i}", "", "", "MALE", "P0") for i, n in enumerate(NAMES)]
    on_x = df.withColumn("chromosome", F.when(F.col("chromosome").isin("3", "4"), "X").otherwise(F.col("chromosome")))
    return attach(on_x, Metadata({STUDY: Study(STUDY, members, {}, {FILE: NAMES})}))


def _tdt_sql() -> str:
    trios = ", ".join(f"({c}, {f}, {m}, {str(male).lower()})" for c, f, m, male in _TRIOS)
    return f""", trio(cs, fs, ms, male) AS (VALUES {trios}),
      g AS (SELECT c.id, c.chromosome IN ('3', '4') AND male AS sonx, f.d AS f, m.d AS m, c.d AS c FROM trio JOIN l c ON c.s = cs JOIN l f ON f.id = c.id AND f.s = fs JOIN l m ON m.id = c.id AND m.s = ms),
      n AS (SELECT id, CASE WHEN sonx THEN (m = 1)::INTEGER ELSE (f = 1)::INTEGER + (m = 1)::INTEGER END AS het,
              CASE WHEN sonx THEN c // 2 WHEN f = 1 AND m = 1 THEN c WHEN f = 1 THEN c - m // 2 ELSE c - f // 2 END AS alt,
              CASE WHEN sonx THEN m = 1 AND c IN (0, 2) ELSE f IS NOT NULL AND m IS NOT NULL AND c IS NOT NULL AND (f = 1 OR m = 1) AND ({_CODE}) = 0 END AS valid FROM g),
      y AS (SELECT id, coalesce(sum(het - alt) FILTER (valid), 0)::INTEGER AS t1, coalesce(sum(alt) FILTER (valid), 0)::INTEGER AS t2 FROM n GROUP BY id),
      u AS (SELECT *, CASE WHEN t1 + t2 > 0 THEN (t1 - t2) * (t1 - t2) / (t1 + t2)::DOUBLE END AS x FROM y)"""


@query("tdt_siblings_and_x", f"{_tdt_sql()} SELECT id, t1, t2, coalesce(round(x, 6), -1) AS chi, CASE WHEN t2 > 0 THEN round(t1 / t2::DOUBLE, 6) ELSE -1 END AS odds FROM u")
def _(df):
    return family.tdt(_three_couples(df), "P1").select("id", "t1", "t2", r6("chiSquare", "chi"), r6("oddRatio", "odds"))


@query("tdt_p", f"{_tdt_sql()} SELECT id, {_P} AS ln_p FROM u WHERE x IS NOT NULL")
def _(df):
    return family.tdt(_three_couples(df), "P1").where("chiSquare >= 0").select("id", ln5("pValue", "ln_p"))


@query("compound_het", f""", {_TRIO}, x AS (SELECT *, CASE WHEN c = 1 AND f = 1 AND m = 0 THEN 1 WHEN c = 1 AND m = 1 AND f = 0 THEN 2 END AS parent, chromosome || ':' || start || ':' || reference || ':' || alternate AS variant FROM t),
  g AS (SELECT variant, parent, gene FROM x WHERE parent IS NOT NULL UNION SELECT variant, parent, gene2 FROM x WHERE parent IS NOT NULL AND gene2 <> ''),
  n AS (SELECT gene, count(*) AS n FROM g GROUP BY gene HAVING count(*) FILTER (parent = 1) > 0 AND count(*) FILTER (parent = 2) > 0)
  SELECT gene, n::INTEGER AS n, variant FROM g JOIN n USING (gene)""")
def _(df):
    return family.compound_heterozygote(df, FATHER, MOTHER, CHILD).select("gene", F.col("numVariants").alias("n"), "variant")


@query("moi_dominant", f", {_TRIO} SELECT id FROM t WHERE f = 0 AND m = 0 AND b = 0 AND c IN (1, 2)")
def _(df):
    return family.mode_of_inheritance(df, "F1", "dominant", "P1").select("id")


@query("moi_recessive", f", {_TRIO} SELECT id FROM t WHERE f = 1 AND m = 1 AND b IN (0, 1) AND c = 2")
def _(df):
    return family.mode_of_inheritance(df, "F1", "biallelic", "P1").select("id")


@query("moi_xlinked", f", {_TRIO} SELECT id FROM t WHERE chromosome = '3' AND f = 0 AND m = 1 AND b IN (0, 1) AND c = 2")
def _(df):
    on_x = df.where("chromosome = '3'").withColumn("chromosome", F.lit("X"))
    from ..metadata import attach

    return family.mode_of_inheritance(attach(on_x, metadata_of(df)), "F1", "x_Linked_Biallelic", "P1").select("id")


def _moi(name: str, mode: str, where: str, chromosome: str = "", **options) -> None:
    """A mode on family F1: f, m and b are its unaffected father, mother and daughter, c the affected son."""

    @query(name, f", {_TRIO} SELECT id FROM t WHERE {where}" + (" AND chromosome = '3'" if chromosome else ""))
    def _(df):
        if chromosome:
            from ..metadata import attach

            df = attach(df.where("chromosome = '3'").withColumn("chromosome", F.lit(chromosome)), metadata_of(df))
        return family.mode_of_inheritance(df, "F1", mode, "P1", **options).select("id")


_moi("moi_xlinked_monoallelic", "xLinkedMonoallelic", "c = 2 AND f = 0 AND m = 0 AND b = 0", "X")
_moi("moi_xlinked_monoallelic_incomplete", "xLinkedMonoallelic", "c = 2 AND f IN (0, 2) AND m IN (0, 1) AND b IN (0, 1)", "X", incomplete_penetrance=True)
_moi("moi_xlinked_biallelic_incomplete", "xLinkedBiallelic", "c = 2 AND f IN (0, 2) AND m IN (1, 2) AND b IN (0, 1, 2)", "X", incomplete_penetrance=True)
_moi("moi_ylinked", "yLinked", "c IN (1, 2) AND f = 0 AND coalesce(m, 0) = 0 AND coalesce(b, 0) = 0", "Y")
_moi("moi_ylinked_incomplete", "yLinked", "c IN (1, 2) AND f IN (0, 2) AND coalesce(m, 0) = 0 AND coalesce(b, 0) = 0", "Y", incomplete_penetrance=True)
_moi("moi_dominant_incomplete", "monoallelic", "c IN (1, 2) AND f IN (0, 1) AND m IN (0, 1) AND b IN (0, 1)", incomplete_penetrance=True)
_moi("moi_recessive_incomplete", "recessive", "c = 2 AND f IN (1, 2) AND m IN (1, 2) AND b IN (0, 1, 2)", incomplete_penetrance=True)
_moi("moi_dominant_missing_ref", "dominant", "c IN (1, 2) AND coalesce(f, 0) = 0 AND coalesce(m, 0) = 0 AND coalesce(b, 0) = 0", missing_as_reference=True)


# --- pairs of samples ----------------------------------------------------------------------------------------------

def _ibs(where: str = "true", skip: str = "true") -> str:
    return f"""SELECT 'S' || lpad(a.s::VARCHAR, 2, '0') AS one, 'S' || lpad(b.s::VARCHAR, 2, '0') AS two, count(*) FILTER (ok AND abs(a.d - b.d) = 2) AS s0, count(*) FILTER (ok AND abs(a.d - b.d) = 1) AS s1, count(*) FILTER (ok AND a.d = b.d) AS s2,
        round(sum(CASE WHEN ok THEN 1 - abs(a.d - b.d) / 2 END) / count(*) FILTER (ok), 6) AS distance, count(*) FILTER (NOT ok) AS skip
        FROM l a JOIN l b ON a.id = b.id AND a.s < b.s, LATERAL (SELECT coalesce(a.d IS NOT NULL AND b.d IS NOT NULL AND {skip}, false) AS ok) WHERE {where} GROUP BY a.s, b.s"""


def _ibs_columns(df: DataFrame) -> DataFrame:
    return df.select(F.col("samplePair")[0].alias("one"), F.col("samplePair")[1].alias("two"), *(F.col("counts")[k].alias(f"s{k}") for k in range(3)), r6("distance"), "skip")


@query("ibs", _ibs())
def _(df):
    return _ibs_columns(pairwise.ibs(df))


@query("ibs_skip_ref", _ibs(skip="NOT (a.d = 0 AND b.d = 0)"))
def _(df):
    return _ibs_columns(pairwise.ibs(df, skip_reference=True))


@query("ibs_subset", _ibs(where="a.s IN (1, 4, 9, 13) AND b.s IN (1, 4, 9, 13)"))
def _(df):
    return _ibs_columns(pairwise.ibs(df, [NAMES[i] for i in (1, 4, 9, 13)]))


@query("ibd_expectations", """, c AS (SELECT id, 2.0::DOUBLE * count(d) AS n, sum(d)::DOUBLE AS y FROM l GROUP BY id), e AS (SELECT n, n - y AS x, y, (n - y) / n AS p, y / n AS q FROM c WHERE n > 3 AND y > 0 AND y < n)
  SELECT round(avg(2 * p * p * q * q * ((x - 1) / x) * ((y - 1) / y) * n * n * n / ((n - 1) * (n - 2) * (n - 3))), 6) AS e00, round(avg((2 * p * p * q * ((x - 1) / x) + 2 * p * q * q * ((y - 1) / y)) * n * n / ((n - 1) * (n - 2))), 6) AS e11 FROM e""")
def _(df):
    return pairwise.expected_sharing(df).select(r6("E00", "e00"), r6("E11", "e11"))


_E = {
    "e00": "2 * p * p * q * q * ((x - 1) / x) * ((y - 1) / y) * n3", "e01": "4 * p * p * p * q * ((x - 1) / x) * ((x - 2) / x) * n3 + 4 * p * q * q * q * ((y - 1) / y) * ((y - 2) / y) * n3",
    "e02": "(p * p * p * p * ((x - 1) / x) * ((x - 2) / x) * ((x - 3) / x) + q * q * q * q * ((y - 1) / y) * ((y - 2) / y) * ((y - 3) / y) + 4 * p * p * q * q * ((x - 1) / x) * ((y - 1) / y)) * n3",
    "e11": "(2 * p * p * q * ((x - 1) / x) + 2 * p * q * q * ((y - 1) / y)) * n2", "e12": "(p * p * p * ((x - 1) / x) + q * q * q * ((y - 1) / y) + p * p * q * ((x - 1) / x) + p * q * q * ((y - 1) / y)) * n2",
}
#: Negative shares become 0 in turn, the other two are scaled to a sum of 1.
_WITHOUT = "SELECT one, two, CASE WHEN z{k} < 0 THEN {v0} ELSE z0 END AS z0, CASE WHEN z{k} < 0 THEN {v1} ELSE z1 END AS z1, CASE WHEN z{k} < 0 THEN {v2} ELSE z2 END AS z2, over FROM {t}"
_BOUND = [_WITHOUT.format(k=k, t=f"b{k}", **{f"v{i}": "0" if i == k else f"z{i} / nullif(z{(3 - k - i) % 3} + z{i}, 0)" for i in range(3)}) for k in range(3)]


@query("ibd", f""", c AS (SELECT id, 2.0::DOUBLE * count(d) AS n, sum(d)::DOUBLE AS y FROM l GROUP BY id), w AS (SELECT n, n - y AS x, y, (n - y) / n AS p, y / n AS q, n * n * n / ((n - 1) * (n - 2) * (n - 3)) AS n3, n * n / ((n - 1) * (n - 2)) AS n2 FROM c WHERE n > 3 AND y > 0 AND y < n),
  e AS (SELECT {", ".join(f"avg({v}) AS {k}" for k, v in _E.items())} FROM w), s AS ({_ibs()}),
  z AS (SELECT one, two, s0, s1, s2, s0 + s1 + s2 AS t, s0 / (e00 * (s0 + s1 + s2)) AS z0, e01, e02, e11, e12 FROM s, e), y AS (SELECT *, (s1 - z0 * e01 * t) / (e11 * t) AS z1 FROM z),
  a AS (SELECT one, two, z0, z1, (s2 - z0 * e02 * t - z1 * e12 * t) / t AS z2 FROM y), b0 AS (SELECT *, CASE WHEN z0 > 1 THEN 0 WHEN z1 > 1 THEN 1 WHEN z2 > 1 THEN 2 END AS over FROM a),
  b1 AS ({_BOUND[0]}), b2 AS ({_BOUND[1]}), b3 AS ({_BOUND[2]}),
  f AS (SELECT one, two, CASE WHEN over IS NULL THEN [z0, z1, z2] ELSE [(over = 0)::INTEGER::DOUBLE, (over = 1)::INTEGER::DOUBLE, (over = 2)::INTEGER::DOUBLE] END AS z FROM b3)
  SELECT one, two, list_transform(z, lambda x: round(x, 6)) AS ibd, round(z[2] / 2 + z[3], 6) AS pi_hat FROM f""")
def _(df):
    return pairwise.ibd(df).select(F.col("samplePair")[0].alias("one"), F.col("samplePair")[1].alias("two"), F.transform("IBD", lambda x: F.round(x, 6)).alias("ibd"), r6("PI_HAT", "pi_hat"))


@query("pca")
def _(df):
    from pyspark.ml.functions import vector_to_array

    return pairwise.pca(df).select("sampleId", F.transform(vector_to_array("PCA"), lambda x: F.round(x, 4)).alias("scores"))


@query("pca_products", f""", m AS (SELECT id, avg(d) AS mean FROM l GROUP BY id HAVING count(d) > 0), x AS (SELECT id, s, coalesce(d, mean) - mean AS x FROM l JOIN m USING (id))
  SELECT 'S' || lpad(a.s::VARCHAR, 2, '0') AS one, 'S' || lpad(b.s::VARCHAR, 2, '0') AS two, round(sum(a.x * b.x), 3) + 0.0 AS product FROM x a JOIN x b ON a.id = b.id AND a.s <= b.s GROUP BY a.s, b.s""")
def _(df):
    """All components together give back the products of the centred genotypes, whatever the components' signs."""
    from pyspark.ml.functions import vector_to_array

    scores = pairwise.pca(df, k=len(NAMES)).select("sampleId", vector_to_array("PCA").alias("x"))
    a, b = scores.select(F.col("sampleId").alias("one"), F.col("x").alias("a")), scores.select(F.col("sampleId").alias("two"), F.col("x").alias("b"))
    product = F.aggregate(F.zip_with("a", "b", lambda p, q: p * q), F.lit(0.0), lambda t, y: t + y)
    return a.join(b, F.col("one") <= F.col("two")).select("one", "two", (F.round(product, 3) + F.lit(0.0)).alias("product"))  # samples only, one row each


def _cmc_sql(by: str) -> str:
    return f""", g AS (SELECT {by} AS grp, s, count(*) AS n, sum(coalesce(d, 0)) AS dose FROM l GROUP BY ALL), y AS (SELECT grp, n, s, CASE WHEN n > 1 THEN (dose > 0)::INTEGER ELSE dose END AS y FROM g),
      t AS (SELECT grp, n, avg(y) FILTER (s < 8) - avg(y) FILTER (s >= 8) AS diff, (7 * var_samp(y) FILTER (s < 8) + 8 * var_samp(y) FILTER (s >= 8)) / 15 AS pooled FROM y GROUP BY ALL)
      SELECT grp, n AS variants, n AS rare, round(72 / 17.0::DOUBLE * diff * diff / greatest(pooled, 1e-8), 4) AS t2 FROM t"""


def _cmc(df: DataFrame, by) -> DataFrame:
    tested = pairwise.cmc(df.withColumn("_by", by), "_by", cases=CASES, controls=CONTROLS, maf=1.1, permutations=1)
    return tested.select(F.col("group").alias("grp"), "variants", "rare", F.round("t2", 4).alias("t2"))


@query("cmc_single", _cmc_sql("id"))
def _(df):
    return _cmc(df, F.col("id"))


@query("cmc_collapsed", _cmc_sql("gene || ':' || chromosome"))
def _(df):
    return _cmc(df, F.concat_ws(":", "gene", "chromosome"))


@query("cmc")
def _(df):
    return pairwise.cmc(df, "biotype", cases=CASES, controls=CONTROLS)


@query("ped_lines", "SELECT line FROM (SELECT CASE WHEN s < 4 THEN 'F1' ELSE 'F' || s END || chr(9) || 'S' || lpad(s::VARCHAR, 2, '0') || chr(9) || CASE WHEN s IN (2, 3) THEN 'S00' ELSE '0' END || chr(9) || CASE WHEN s IN (2, 3) THEN 'S01' ELSE '0' END || chr(9) || CASE WHEN s % 2 = 0 THEN '1' ELSE '2' END || chr(9) || CASE WHEN s IN (0, 1, 3) THEN 'P0' WHEN s < 8 THEN 'P1' ELSE 'P2' END AS line FROM range(17) t(s))")
def _(df):
    return df.sparkSession.createDataFrame([(x,) for x in IO.ped(df)], "line string")
