"""Operators on the synthetic variants; the catalogue is compared with DuckDB, the rest with plain Python."""

import gzip
import json
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe import metadata as M
from helixframe.errors import HelixError
from helixframe.functions import variant as V
from helixframe.operators import association, facet, family, pairwise, stats
from helixframe.plans import synthetic as S
from helixframe.plans.catalogue import CATALOGUE
from helixframe.session import Helix
from helixframe.sources import variants as IO

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def df(spark):
    out = S.variants(spark, SF).cache()
    out = M.attach(out, S.metadata())
    yield out
    out.unpersist()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def flat(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, np.ndarray):
        value = value.tolist()
    if isinstance(value, (list, tuple)):
        return tuple(map(flat, value))
    return value.item() if hasattr(value, "item") else value


@pytest.mark.parametrize("name", sorted(CATALOGUE))
def test_catalogue(spark, duck, name):
    q = CATALOGUE[name]
    got = q.run(spark, SF).toPandas()
    if q.sql is None:
        assert len(got) > 0
        return
    want = duck.sql(q.sql).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda t: sorted((tuple(map(flat, r)) for r in t[columns].astype(object).itertuples(index=False)), key=repr)
    assert rows(got) == rows(want)


def test_metadata_survives(spark, df, tmp_path):
    assert M.samples(df, S.STUDY) == S.NAMES and M.studies(df) == [S.STUDY]
    assert [m.sample for m in M.pedigree(df, S.STUDY, "F1")] == S.NAMES[:4]
    df.write.parquet(f"{tmp_path}/v.parquet")
    assert M.metadata_of(spark.read.parquet(f"{tmp_path}/v.parquet")).studies == S.metadata().studies
    with pytest.raises(HelixError, match="Unknown study"):
        M.samples(df, "none")
    with pytest.raises(HelixError, match="Unknown family"):
        M.pedigree(df, S.STUDY, "none")


def test_load(spark, df, tmp_path):
    path = f"{tmp_path}/set.parquet"
    df.drop("studies").withColumn("studies", F.lit(None).cast(df.schema["studies"].dataType)).write.parquet(path)
    side = {"studies": [{"id": "s", "individuals": [{"id": "i", "family": "f", "sex": "MALE", "phenotype": "p", "father": "", "mother": None, "samples": [{"id": "a", "annotations": {"k": 1}}]}], "cohorts": [{"id": "ALL", "sampleIds": ["a"]}]}]}
    with gzip.open(f"{path}.meta.json.gz", "wt") as f:
        json.dump(side, f)
    loaded = Helix(spark).load(path)
    assert M.samples(loaded) == {"s": ["a"]} and M.metadata_of(loaded).study().cohorts == {"ALL": ["a"]}
    with pytest.raises(HelixError, match="Unsupported format"):
        IO.load(spark, "x.vcf")
    with pytest.raises(HelixError, match="avro"):
        IO.load(spark, "x.avro")


def test_stats_keep_other_studies_and_cohorts(df):
    two = stats.variant_stats(stats.variant_stats(df), "few", S.NAMES[:2])
    assert two.select(F.map_keys(F.col("studies")[0]["stats"])).first()[0] == ["ALL", "few"]
    assert M.metadata_of(two).study().cohorts["few"] == S.NAMES[:2]
    with pytest.raises(HelixError, match="Sample 'nobody' not found"):
        stats.variant_stats(df, samples=["nobody"])


def test_histogram_types(df):
    out = stats.histogram(df, "start", 1000)
    assert dict(out.dtypes) == {"start": "int", "count": "bigint"}
    with pytest.raises(HelixError, match="Input column must be NumericType"):
        stats.histogram(df, "annotation")


def test_facets(df):
    with pytest.raises(HelixError, match="In nested facets, aggregations must be in last place"):
        facet.parse("biotype>>avg(gerp)>>type")
    with pytest.raises(HelixError, match="Aggregation function unknown"):
        facet.parse("mode(gerp)")
    assert facet.facet(df, "").columns == []
    root = facet.tree(facet.facet(df, "type>>chromosome[1,2]>>avg(gerp)"))
    assert root.name == "type" and sum(b.count for b in root.buckets) == root.count
    assert all(c.value in "12" and c.fields[0].aggregation == "avg" for b in root.buckets for c in b.fields[0].buckets)


def test_mendelian_codes(spark):
    cases = [("0/0", "0/0", "0/1", 1), ("1/1", "1/1", "0/1", 2), ("1/1", "0/1", "0/0", 3), ("0/1", "1/1", "0/0", 4), ("1/1", "1/1", "0/0", 5), ("0/0", "0/1", "1/1", 6), ("0/1", "0/0", "1/1", 7), ("0/0", "0/0", "1/1", 8), ("0/1", "0/1", "1/1", 0), (None, "1|1", "0|0", 4), ("0/0", "1/1", "0/1", 0)]
    rows = spark.createDataFrame([(*c, "1", False) for c in cases] + [("0/0", "0/0", "1/1", 9, "X", True), ("1/1", "1/1", "0/0", 10, "X", True)], "f string, m string, c string, want int, chrom string, male boolean")
    for r in rows.withColumn("code", family.mendelian_code(*map(F.col, ("f", "m", "c", "chrom", "male")))).collect():
        assert r["code"] == r["want"], r


def test_inheritance_tables():
    study = S.metadata().study()
    assert family.allowed_genotypes(study, "F1", "DOMINANT", "P1") == {"S00": ["0/0"], "S01": ["0/0"], "S02": ["0/1", "1/1"], "S03": ["0/0"]}
    assert "./." in family.allowed_genotypes(study, "F1", "recessive", "P1", missing_as_reference=True)["S03"]
    with pytest.raises(HelixError, match="Unknown mode"):
        family.allowed_genotypes(study, "F1", "sideways", "P1")


def test_pairs(df):
    rows = pairwise.ibs(df).collect()
    assert len(rows) == 17 * 16 // 2 and all(0 <= r["distance"] <= 1 for r in rows)
    for r in pairwise.ibd(df).collect():
        assert sum(r["IBD"]) == pytest.approx(1) and 0 <= r["PI_HAT"] <= 1


def test_ibs_multi_allelic(spark, df):
    first = df.limit(1).withColumn("studies", F.transform("studies", lambda s: s.withField("samplesData", F.array(*(F.array(F.lit(g)) for g in ("1/2", "0/2", "1/1", "./.", "2/1"))))))
    study = M.Study(S.STUDY, [M.Member(f"m{i}") for i in range(5)])
    got = {tuple(r["samplePair"]): list(r["counts"]) for r in pairwise.ibs(M.attach(first, M.Metadata({S.STUDY: study})), skip_multi_allelic=False).collect()}
    assert got["m0", "m1"] == [0, 1, 0] and got["m0", "m4"] == [0, 0, 1] and got["m1", "m2"] == [1, 0, 0] and got["m0", "m3"] == [0, 0, 0]


def test_pca_equals_svd(df):
    rows = pairwise.pca(df, k=2).collect()
    gts = df.select(F.transform(F.col("studies")[0]["samplesData"], lambda x: x[0]).alias("g")).toPandas()["g"]
    dose = {"0/0": 0.0, "0/1": 1.0, "1/1": 2.0}
    x = np.array([[dose.get(g, np.nan) for g in row] for row in gts])
    x = x[~np.isnan(x).all(1)]
    mean = np.nanmean(x, 1, keepdims=True)
    x = np.where(np.isnan(x), mean, x) - mean
    x = x - x.mean(1, keepdims=True)
    _, s, v = np.linalg.svd(x, full_matrices=False)
    got = np.array([r["PCA"].toArray() for r in rows])
    assert [r["sampleId"] for r in rows] == S.NAMES and np.allclose(np.abs(got), np.abs(v[:2].T * s[:2]), atol=1e-6)


def test_burden(df):
    rows = pairwise.cmc(df, "type", cases=S.CASES, controls=S.CONTROLS, permutations=20).collect()
    assert {r["group"] for r in rows} == {"SNV", "INDEL"} and all(0 < r["permutationPValue"] <= 1 for r in rows)
    assert pairwise.f_tail(4.0, 1, 10) == pytest.approx(0.07339, abs=1e-4) and pairwise.f_tail(0.5, 3, 12) == pytest.approx(0.68927, abs=1e-3)


def test_gwas_sides(df):
    study = S.metadata().study()
    cases, controls = association.case_control(study, cases=S.CASES)
    assert controls == list(range(8, 17)) and cases == list(range(8))
    with pytest.raises(HelixError, match="Missing param"):
        association.gwas(df)
    assert {"pValue", "oddRatio"} <= set(association.gwas(df, cohorts=("half", None)).columns)
    assert {"chiSquare", "pValue", "oddRatio"} <= set(association.gwas(df, method="chi-square-test", phenotypes=("P1", "P2")).columns)


def test_gwas_refuses_empty_sides(df):
    with pytest.raises(HelixError, match="no_such_phenotype"):
        association.gwas(df, phenotypes=("P1", "no_such_phenotype"))
    with pytest.raises(HelixError, match="one sample each"):
        association.gwas(df, samples=(S.CASES, []))
    with pytest.raises(HelixError, match="one sample each"):
        association.case_control(S.metadata().study(), cases=S.NAMES)


def test_transmission_on_x(spark):
    """A son has his one X from his mother; a daughter has one of each."""
    cases = [("0/0", "1/1", "0/1", "X", "MALE"), ("1/1", "0/0", "0/1", "X", "MALE"), ("0/1", "0/0", "0/1", "X", "MALE"), ("0/0", "0/1", "0/0", "X", "MALE"), ("0/1", "1/1", "0/1", "X", "FEMALE"), ("0/0", "0/1", "0/1", "2", "MALE")]
    want = [(1, 0), (0, 1), (0, 0), (0, 0), (1, 0), (2, 0)]
    for (child, father, mother, chromosome, sex), counts in zip(cases, want, strict=True):
        row = spark.createDataFrame([(chromosome, [("s", [[child], [father], [mother]])])], "chromosome string, studies array<struct<studyId:string,samplesData:array<array<string>>>>")
        members = [M.Member("c", "f", "p", "m", sex, "ill"), M.Member("p"), M.Member("m")]
        got = family.tdt(M.attach(row, M.Metadata({"s": M.Study("s", members)})), "ill").first()
        assert (got["t1"], got["t2"]) == counts, (child, father, mother, sex)


def test_vectors(spark):
    from helixframe.functions import vectors as X

    a = F.col("a")
    row = spark.createDataFrame([([3.0, 1.0, 2.0, 1.0],), ([],)], "a array<double>").select(X.order(a), X.order(a, True), X.ordered(a, X.order(a)), X.min_index(a), X.max_index(a), X.pmax(2.0, a), X.finite_min(F.concat(a, F.array(F.lit(float("-inf"))))), X.finite_max(a)).collect()
    assert list(row[0]) == [[1, 3, 2, 0], [0, 2, 1, 3], [1.0, 1.0, 2.0, 3.0], 1, 0, [3.0, 2.0, 2.0, 2.0], 1.0, 3.0]
    assert list(row[1]) == [[], [], [], None, None, [], None, None]


def test_rewrite_and_included_studies(spark, df, tmp_path):
    df.select("id", "start").write.parquet(f"{tmp_path}/a")
    IO.rewrite(spark, f"{tmp_path}/a", "id string, start int, more string", f"{tmp_path}/b")
    back = spark.read.parquet(f"{tmp_path}/b")
    assert back.columns == ["id", "start", "more"] and back.count() == df.count() and back.where("more IS NOT NULL").count() == 0
    kept = df.select(F.size(V.include_studies("studies", "other")).alias("none"), F.size(V.include_studies("studies", f"{S.STUDY}, x")).alias("one")).distinct().collect()
    assert [tuple(r) for r in kept] == [(0, 1)]


def test_regressions(df):
    rows = df.select(F.length("gene").cast("double").alias("y"), "score", (F.col("score") > 909).cast("double").alias("big"))
    assert association.linear_regression(rows, "y", "score").coefficients.size == 1
    assert association.logistic_regression(rows, "big", "score").numClasses == 2


def test_sinks(spark, df, tmp_path):
    IO.write_tsv(IO.consequence_rows(df, []), f"{tmp_path}/tsv")
    back = spark.read.option("sep", "\t").option("header", True).csv(f"{tmp_path}/tsv")
    assert back.count() == 2 * df.count() and back.columns[:3] == ["chromosome", "start", "reference"]
    IO.write_json(stats.variant_set_stats(df), f"{tmp_path}/set.json")
    assert json.loads((tmp_path / "set.json").read_text())[0]["numVariants"] == df.count()
    IO.write_vcf(df, f"{tmp_path}/vcf")
    lines = "".join(p.read_text() for p in sorted((tmp_path / "vcf").glob("part-*"))).splitlines()
    head = [line for line in lines if line.startswith("#")]
    assert head == lines[: len(head)] and head[0] == "##fileformat=VCFv4.2" and head[-1].split("\t") == ["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *S.NAMES]
    assert len(lines) - len(head) == df.count() and all(len(line.split("\t")) == 9 + 17 for line in lines[len(head) :])
    assert IO.ped(df)[2].split("\t")[:5] == ["F1", "S02", "S00", "S01", "1"]
    assert IO.ped_genotypes(df.limit(3)).count() == 17


def test_sql_functions(spark, df):
    Helix(spark).register(df, "all_variants")
    sql = spark.sql(f"SELECT revcomp(reference) AS a, genes(annotation) AS b, conservation(annotation, 'gerp') AS c, functional(annotation, 'cadd_raw') AS d, protein_substitution(annotation, 'sift') AS e, file_qual(studies, '{S.FILE}') AS f, consequence_types_by_gene(annotation, 'G1') AS g, study(studies, '{S.STUDY}').studyId AS h, sample_data_field(studies, 'S03', 'DP') AS i FROM all_variants ORDER BY id").collect()
    at = V.sample_index(M.metadata_of(df), "S03")
    col = df.orderBy("id").select(V.revcomp("reference"), V.genes("annotation"), V.conservation("annotation", "gerp"), V.functional("annotation", "cadd_raw"), V.protein_substitution("annotation", "sift"), V.file_qual("studies", S.FILE), V.consequence_types_by_gene("annotation", "G1"), V.study("studies", S.STUDY)["studyId"], V.sample_data_field("studies", at, "DP")).collect()
    assert [tuple(r) for r in sql] == [tuple(r) for r in col]


def test_streaming_density(spark, df, tmp_path):
    from helixframe.streaming.density import stream_density

    df.select("chromosome", "start").write.parquet(f"{tmp_path}/in")
    rows = spark.readStream.schema("chromosome string, start int").parquet(f"{tmp_path}/in")
    q = stream_density(rows, "density", f"{tmp_path}/state")
    q.processAllAvailable()
    q.stop()
    assert spark.table("density").agg(F.sum("count")).first()[0] == df.count()


def burden_set(spark, genotypes, groups):
    """Variants of 17 samples (rows of genotypes) in groups, with metadata."""
    names = {0: "0/0", 1: "0/1", 2: "1/1"}
    rows = [(g, [(S.STUDY, [[names[d]] for d in row])]) for g, row in zip(groups, genotypes.tolist(), strict=True)]
    return M.attach(spark.createDataFrame(rows, "by string, studies array<struct<studyId:string,samplesData:array<array<string>>>>"), S.metadata())


def test_burden_of_a_large_group(spark):
    """30,000 variants in one group: their covariance alone would have 7 GB."""
    x = np.random.default_rng(3).choice(3, (30_000, 17), p=(0.5, 0.3, 0.2))
    x[:100] = 0
    x[:100, 4] = 1  # rare in all
    row = pairwise.cmc(burden_set(spark, x, ["g"] * len(x)).repartition(5), "by", cases=S.CASES, controls=S.CONTROLS, permutations=3).first()
    design = np.concatenate([x[100:].T, (x[:100] > 0).any(0)[:, None]], 1).astype(float)
    one, two = design[:8], design[8:]
    _, s, v = np.linalg.svd(np.concatenate([one - one.mean(0), two - two.mean(0)]), full_matrices=False)
    along = (v @ (one.mean(0) - two.mean(0)))[s > 1e-3]
    assert (row["variants"], row["rare"]) == (30_000, 100) and row["t2"] == pytest.approx(72 / 17 * (along**2 / (s[s > 1e-3] ** 2 / 15)).sum(), rel=1e-9)
    assert math.isnan(row["pValue"]) and 0 < row["permutationPValue"] <= 1


def test_burden_of_many_groups(spark):
    """Groups of one to three variants over several tasks: by the plain formula for each."""
    rng = np.random.default_rng(4)
    x, groups = rng.choice(3, (6000, 17), p=(0.93, 0.05, 0.02)), [f"g{k}" for k in rng.integers(0, 3000, 6000)]
    rows = pairwise.cmc(burden_set(spark, x, groups).repartition(7), "by", cases=S.CASES, controls=S.CONTROLS, permutations=5).collect()
    assert len(rows) == len(set(groups))
    of = {}
    for g, r in zip(groups, x, strict=True):
        of.setdefault(g, []).append(r)
    for r in rows[::20]:
        d = np.array(of[r["group"]], float).T
        rare = d.mean(0) / 2 < 0.05
        assert (r["variants"], r["rare"]) == (d.shape[1], rare.sum())
        d = np.concatenate([d[:, ~rare], (d[:, rare] > 0).any(1)[:, None]], 1) if rare.sum() > 1 else d
        pooled = (7 * np.atleast_2d(np.cov(d[:8].T)) + 8 * np.atleast_2d(np.cov(d[8:].T))) / 15
        diff = d[:8].mean(0) - d[8:].mean(0)
        want = diff[0] ** 2 / max(pooled[0, 0], 1e-8) if len(diff) == 1 else diff @ np.linalg.pinv(pooled, 1e-9, hermitian=True) @ diff
        assert r["t2"] == pytest.approx(72 / 17 * want, rel=1e-6, abs=1e-9)


def test_burden_parts_are_bounded():
    import pyarrow as pa

    g = np.random.default_rng(5).choice(3, (70_000, 17)).astype(np.int8)
    groups = np.array(["a", "b", "c"])[np.r_[np.zeros(69_000, int), np.arange(1000) % 2 + 1]]
    batch = pa.RecordBatch.from_arrays([pa.array(groups), pa.array(list(g), pa.list_(pa.int8()))], ["group", "g"])
    parts = list(pairwise.burden_parts(iter([batch]), 17, 0.05))
    assert sum(p.num_rows for p in parts) <= 6 and sum(p.nbytes for p in parts) < 20_000
    rows = sorted((p.slice(k, 1) for p in parts for k in range(p.num_rows)), key=lambda p: p.column(0)[0].as_py())
    tested = pa.Table.from_batches(pairwise.burden_tests(iter(rows), 8, 17, 2, 1))
    assert tested["variants"].to_pylist() == [69_000, 500, 500]


def test_parts_are_dealt(spark, tmp_path):
    """One small file of many parts is more than one task, and each part is there once."""
    spark.range(0, 150_000, 1, 1).selectExpr("id AS p_partkey", "'n' AS p_name", "'b' AS p_brand", "md5(string(id)) AS p_type", "int(id % 50 + 1) AS p_size", "1.0D AS p_retailprice").write.parquet(f"{tmp_path}/part.parquet")
    df = S.variants(spark, str(tmp_path))
    tasks = df.select("id", "biotype").groupBy(F.spark_partition_id()).agg(F.count("*"), F.count_distinct("id")).collect()
    assert len(tasks) > 8 and sum(t[1] for t in tasks) == sum(t[2] for t in tasks) == 150_000 and max(t[1] for t in tasks) < 20_000


def test_statistics_by_distinct_genotype(spark, df):
    """Texts are split in one place, once for each distinct genotype; equal ones are merged after they are cleaned."""
    plan = stats.variant_stats(df).select(F.col("studies")[0]["stats"]["ALL"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") <= 2 and "flatten(" not in plan
    row = spark.createDataFrame([(["0|1", "1/0", "1/2", "?/?", None, "./1", "1"],)], "g array<string>").select(stats.stats_struct(F.col("g")).alias("s")).first()["s"]
    assert row["genotypeCount"] == {"./.": 2, "./1": 1, "0/1": 2, "1": 1, "1/2": 1} and row["missingGenotypeCount"] == 3
    assert (row["alleleCount"], row["refAlleleCount"], row["altAlleleCount"], row["missingAlleleCount"]) == (8, 2, 5, 5)
    assert row["mgfGenotype"] == "1" and row["mgf"] == 0.25 and row["mafAllele"] == "ref"


def test_inbreeding_hands_on_calls_only(spark):
    """What is dealt to samples is the allele frequency and the call, and a variant's statistics are computed once."""
    plan = stats.inbreeding(stats.variant_stats(S.variants(spark, SF)), step=1000)._jdf.queryExecution().optimizedPlan().toString()
    assert "project@set:one" not in plan[: plan.index("Generate inline")] and plan.count("sort_array(") == 1


def test_chi_square_computes_each_step_once(spark, df):
    """The table, the statistic and the error function come once for a variant, and small p-values keep their digits."""
    from helixframe.functions import tests as T

    plan = association.gwas(df, method=association.CHI_SQUARE, samples=(S.CASES, S.CONTROLS)).select("chiSquare", "pValue")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("SQRT(") == 1 and plan.count("aggregate(") == 2 and plan.count("IN (0/0,0|0)") == 2
    for r in spark.range(121).select((F.col("id") / 10).alias("x")).select("x", T.erfc(F.col("x")).alias("y")).collect():
        assert r["y"] == pytest.approx(math.erfc(r["x"]), rel=1e-12)


def test_log_factorials_are_looked_up(spark):
    """No factorial or logarithm for the counts of a small study, the same values on both sides of the table's end."""
    from helixframe.functions import tests as T

    rows = spark.range(400).select(F.col("id").cast("int").alias("n"))
    for r in rows.select("n", T.log_factorial(F.col("n")).alias("y")).collect():
        assert r["y"] == pytest.approx(math.lgamma(r["n"] + 1), rel=1e-12, abs=1e-12)
    assert "factorial(" not in rows.select(T.log_factorial(F.col("n")))._jdf.queryExecution().optimizedPlan().toString().lower()
