"""Operators on trios and families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import HelixError
from ..functions import genotype as G
from ..functions.tests import chi_square_p, once
from ..functions.variant import genes
from ..metadata import Study, metadata_of


def mendelian_code(father: Column, mother: Column, child: Column, chromosome: Column, male: Column) -> Column:
    """Code 1 to 10 of the inconsistency of a child's genotype with its parents'; 0 where there is none or no telling.

    A parent without genotype is unknown. On X a son has nothing from his father: 9 and 10 stand for a
    homozygous son that his mother contradicts.
    """
    f, m, c = (F.coalesce(G.dosage(x), F.lit(-1)) for x in (father, mother, child))
    on_x = chromosome.isin("X", "chrX") & male
    autosomal = (
        F.when((f == 0) & (m == 0) & (c == 1), 1).when((f == 2) & (m == 2) & (c == 1), 2).when((f == 2) & (m == 2) & (c == 0), 5).when((f == 0) & (m == 0) & (c == 2), 8)
        .when((f == 2) & (c == 0), 3).when((m == 2) & (c == 0), 4).when((f == 0) & (c == 2), 6).when((m == 0) & (c == 2), 7).otherwise(0)
    )
    return F.when(on_x, F.when((m == 0) & (c == 2), 9).when((m == 2) & (c == 0), 10).otherwise(0)).otherwise(autosomal)


def mendelian_error(df: DataFrame, father: str, mother: str, child: str, study: str = "") -> DataFrame:
    """Adds mendelianError. An empty father or mother is unknown."""
    chosen = metadata_of(df).first(study)
    gt = lambda name: G.genotype_at(F.col("studies"), chosen.id, chosen.index(name)) if name else F.lit(None).cast("string")
    male = F.lit(chosen.member(child).sex.upper() == "MALE")
    return df.withColumn("mendelianError", mendelian_code(gt(father), gt(mother), gt(child), F.col("chromosome"), male))


DOMINANT, RECESSIVE, X_DOMINANT, X_RECESSIVE, Y_LINKED = "dominant", "recessive", "xLinkedMonoallelic", "xLinkedBiallelic", "yLinked"
_MODES = {"dominant": DOMINANT, "monoallelic": DOMINANT, "recessive": RECESSIVE, "biallelic": RECESSIVE, "xlinkedmonoallelic": X_DOMINANT, "xlinkeddominant": X_DOMINANT, "xlinkedbiallelic": X_RECESSIVE, "xlinkedrecessive": X_RECESSIVE, "ylinked": Y_LINKED}


def allowed_genotypes(study: Study, family: str, mode: str, phenotype: str, incomplete_penetrance: bool = False, missing_as_reference: bool = False) -> dict[str, list[str]]:
    """Genotypes that each member of a family may have; members without restriction are left out."""
    kind = _MODES.get(mode.lower().replace("_", ""))
    if kind is None:
        raise HelixError(f"Unknown mode of inheritance '{mode}'")
    members = study.family(family)
    affected = {m.sample: m.phenotype == phenotype for m in members}
    parents = {p for m in members if affected[m.sample] for p in (m.father, m.mother) if p}
    out: dict[str, list[str]] = {}
    for m in members:
        ill, male, parent = affected[m.sample], m.sex.upper() == "MALE", m.sample in parents
        if kind == DOMINANT:
            allowed = ["0/1", "1/1"] if ill else ["0/0", "0/1"] if incomplete_penetrance else ["0/0"]
        elif kind == RECESSIVE:
            allowed = ["1/1"] if ill else ["0/1", "1/1"] if parent and incomplete_penetrance else ["0/1"] if parent else ["0/0", "0/1", "1/1"] if incomplete_penetrance else ["0/0", "0/1"]
        elif kind == X_DOMINANT:
            allowed = (["1/1", "1"] if male else ["0/1", "1/1"]) if ill else (["0/0", "0"] if male else ["0/0", "0/1"] if incomplete_penetrance else ["0/0"])
            if not ill and male and incomplete_penetrance:
                allowed += ["1/1", "1"]
        elif kind == X_RECESSIVE:
            allowed = ["1/1", "1"] if ill and male else ["1/1"] if ill else ["0/0", "0"] if male else ["0/1"] if parent else ["0/0", "0/1"]
            if not ill and incomplete_penetrance:
                allowed += ["1/1", "1"]
        else:
            allowed = (["1/1", "0/1", "1"] if ill else ["0/0", "0"] + (["1/1", "1"] if incomplete_penetrance else [])) if male else ["0/0", "./.", "."]
        if missing_as_reference and "0/0" in allowed:
            allowed = [*allowed, "./."]
        out[m.sample] = list(dict.fromkeys(allowed))
    return out


def mode_of_inheritance(df: DataFrame, family: str, mode: str, phenotype: str, study: str = "", incomplete_penetrance: bool = False, missing_as_reference: bool = False) -> DataFrame:
    """Variants whose genotypes in a family agree with a mode of inheritance; phase does not matter."""
    chosen = metadata_of(df).study(study)
    kind = _MODES.get(mode.lower().replace("_", ""))
    allowed = allowed_genotypes(chosen, family, mode, phenotype, incomplete_penetrance, missing_as_reference)
    if kind in (X_DOMINANT, X_RECESSIVE):
        df = df.where(F.col("chromosome").isin("X", "chrX"))
    elif kind == Y_LINKED:
        df = df.where(F.col("chromosome").isin("Y", "chrY"))
    for sample, gts in allowed.items():
        df = df.where(G.normalise(G.genotype_at(F.col("studies"), chosen.id, chosen.index(sample))).isin(gts))
    return df


def compound_heterozygote(df: DataFrame, father: str, mother: str, child: str, study: str = "", missing_as_reference: bool = False) -> DataFrame:
    """gene, numVariants, variant: genes where the child has a variant from its father and one from its mother.

    A variant has its parent where the child is heterozygous, that parent too, and the other is homozygous reference.
    """
    chosen = metadata_of(df).first(study)

    def dose(name: str) -> Column:
        gt = G.genotype_at(F.col("studies"), chosen.id, chosen.index(name))
        return G.dosage(F.replace(F.replace(gt, F.lit("."), F.lit("0")), F.lit("?"), F.lit("0")) if missing_as_reference else gt)

    f, m, c = dose(father), dose(mother), dose(child)
    parent = F.when((c == 1) & (f == 1) & (m == 0), 1).when((c == 1) & (m == 1) & (f == 0), 2)
    part = lambda name: F.when(F.col(name) == "", "-").otherwise(F.col(name))
    variant = F.concat_ws(":", "chromosome", F.col("start").cast("string"), part("reference"), part("alternate"))
    rows = df.select(parent.alias("parent"), variant.alias("variant"), genes("annotation").alias("genes")).where(F.col("parent").isNotNull())
    grouped = rows.select("parent", "variant", F.explode("genes").alias("gene")).groupBy("gene").agg(F.collect_list(F.when(F.col("parent") == 1, F.col("variant"))).alias("a"), F.collect_list(F.when(F.col("parent") == 2, F.col("variant"))).alias("b"))
    both = grouped.where((F.size("a") > 0) & (F.size("b") > 0))
    return both.select("gene", (F.size("a") + F.size("b")).alias("numVariants"), F.explode(F.concat("a", "b")).alias("variant"))


def tdt(df: DataFrame, phenotype: str, study: str = "") -> DataFrame:
    """Transmission test over affected children with both parents; adds chiSquare, pValue, oddRatio, freedomDegrees, t1, t2.

    t1 and t2 are what heterozygous parents hand down: reference and alternate alleles. Trios with a Mendelian error, a
    missing genotype or without heterozygous parent do not count; of several affected siblings each counts with its own
    genotype. On X a son has nothing from his father: he counts by his mother alone, and not at all where he is heterozygous.
    """
    chosen = metadata_of(df).first(study)
    known = set(chosen.samples)
    trios = [(chosen.index(m.sample), chosen.index(m.father), chosen.index(m.mother), m.sex.upper() == "MALE") for m in chosen.members if m.phenotype == phenotype and m.father in known and m.mother in known]
    on_x = F.col("chromosome").isin("X", "chrX")
    # trios are an array of literals that one expression goes over: the plan's size doesn't grow with them
    who = F.array(*(F.struct(*(F.lit(x).alias(n) for n, x in zip(("c", "f", "m", "male"), trio, strict=True))) for trio in trios))

    def handed_down(trio: Column, data: Column) -> Column:
        c, f, m = (F.get(F.get(data, trio[k]), F.lit(0)) for k in "cfm")
        code = mendelian_code(f, m, c, F.col("chromosome"), trio["male"])
        genotypes = F.struct(G.dosage(c).alias("c"), G.dosage(f).alias("f"), G.dosage(m).alias("m"), (code == 0).alias("fits"), (on_x & trio["male"]).alias("son"))

        def count(g: Column) -> Column:
            het = (g["f"] == 1).cast("int") + (g["m"] == 1).cast("int")
            called = g["c"].isNotNull() & g["f"].isNotNull() & g["m"].isNotNull()
            other = F.when(g["f"] == 1, g["m"]).otherwise(g["f"])  # the homozygous parent of a trio with one heterozygous
            alt = F.when(het == 2, g["c"]).otherwise(g["c"] - (other / 2).cast("int"))  # alternate alleles from heterozygous parents
            son = F.when(g["fits"] & (g["c"] != 1) & (g["m"] == 1), F.struct((1 - (g["c"] / 2).cast("int")).alias("t1"), (g["c"] / 2).cast("int").alias("t2")))
            any_child = F.when(g["fits"] & called & (het > 0), F.struct((het - alt).cast("int").alias("t1"), alt.cast("int").alias("t2")))
            return F.when(g["son"], son).otherwise(any_child)

        return once(genotypes, count)

    none = F.struct(F.lit(0).alias("t1"), F.lit(0).alias("t2"))
    add = lambda a, x: F.struct((a["t1"] + F.coalesce(x["t1"], F.lit(0))).alias("t1"), (a["t2"] + F.coalesce(x["t2"], F.lit(0))).alias("t2"))
    total = once(G.study_of(F.col("studies"), chosen.id)["samplesData"], lambda data: F.aggregate(F.transform(who, lambda trio: handed_down(trio, data)), none, add)) if trios else none
    df = df.withColumn("_tdt", total)
    t1, t2 = F.col("_tdt.t1"), F.col("_tdt.t2")
    out = df.withColumn("t1", t1.cast("int")).withColumn("t2", t2.cast("int")).drop("_tdt")
    n = F.col("t1") + F.col("t2")
    chi = F.when(n > 0, F.try_divide(((F.col("t1") - F.col("t2")) * (F.col("t1") - F.col("t2"))).cast("double"), n)).otherwise(-1.0)
    out = out.withColumn("chiSquare", chi)
    out = out.withColumn("pValue", F.when(F.col("chiSquare") >= 0, chi_square_p(F.col("chiSquare"))).otherwise(-1.0))
    return out.withColumn("oddRatio", F.when(F.col("t2") > 0, F.try_divide(F.col("t1").cast("double"), F.col("t2"))).otherwise(-1.0)).withColumn("freedomDegrees", F.lit(1))
