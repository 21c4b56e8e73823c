"""Accessor functions on variant rows: native expressions, usable as Columns and, once registered, in SQL text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..metadata import Metadata, metadata_of

NEG_INF = float("-inf")


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _first(array: Column, keep) -> Column:
    return F.get(F.filter(array, keep), F.lit(0))


def _value(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def revcomp(allele) -> Column:
    """Reverse complement; ACGT in any case become upper-case, all else stays."""
    return F.translate(F.reverse(_col(allele)), "ACGTacgt", "TGCATGCA")


def study(studies, study_id) -> Column:
    return _first(_col(studies), lambda s: s["studyId"] == _value(study_id))


def file(studies, file_id) -> Column:
    """The first file of that id over all studies."""
    files = F.flatten(F.transform(_col(studies), lambda s: F.coalesce(s["files"], F.filter(s["files"], lambda _: F.lit(False)))))
    return _first(files, lambda f: f["fileId"] == _value(file_id))


def file_attribute(studies, file_id, key) -> Column:
    return F.try_element_at(file(studies, file_id)["attributes"], _value(key))


def file_qual(studies, file_id) -> Column:
    text = file_attribute(studies, file_id, "QUAL")
    return F.when(~text.isin("", "."), text).try_cast("double")


def file_filter(studies, file_id) -> Column:
    text = file_attribute(studies, file_id, "FILTER")
    return F.when(text != "", F.split(text, ";"))


def sample_data(studies, index: dict[str, int]) -> Column:
    """All fields of a sample: its position in each study that has it; the first study wins."""
    of = [F.get(study(studies, s)["samplesData"], F.lit(i)) for s, i in index.items()]
    return F.coalesce(*of) if of else F.lit(None).cast("array<string>")


def sample_data_field(studies, index: dict[str, int], field) -> Column:
    of = []
    for s, i in index.items():
        here = study(studies, s)
        at = F.array_position(here["format"], _value(field)).cast("int")
        of.append(F.when(at > 0, F.get(F.get(here["samplesData"], F.lit(i)), at - 1)))
    return F.coalesce(*of) if of else F.lit(None).cast("string")


def genotype(studies, index: dict[str, int]) -> Column:
    return sample_data_field(studies, index, "GT")


def sample_index(metadata: Metadata, sample: str) -> dict[str, int]:
    """Where a sample stands in each study that has it."""
    return {s.id: s.index(sample) for s in metadata.studies.values() if sample in s.samples}


def _names(annotation, field: str) -> Column:
    values = F.transform(_col(annotation)["consequenceTypes"], lambda c: c[field])
    return F.coalesce(F.array_sort(F.array_distinct(F.filter(values, lambda g: g != ""))), F.array().cast("array<string>"))


def genes(annotation) -> Column:
    return _names(annotation, "geneName")


def ensembl_genes(annotation) -> Column:
    return _names(annotation, "ensemblGeneId")


def biotypes(annotation) -> Column:
    return _names(annotation, "biotype")


def _terms(consequences: Column) -> Column:
    names = F.transform(consequences, lambda c: F.coalesce(F.transform(c["sequenceOntologyTerms"], lambda t: t["name"]), F.array().cast("array<string>")))
    return F.coalesce(F.array_sort(F.array_distinct(F.flatten(names))), F.array().cast("array<string>"))


def consequence_types(annotation) -> Column:
    return _terms(_col(annotation)["consequenceTypes"])


def consequence_types_by_gene(annotation, gene) -> Column:
    """Terms of one gene, named by gene name, gene id or transcript id; an empty gene stands for all."""
    g = _value(gene)
    keep = lambda c: (g == "") | F.coalesce(c["geneName"] == g, F.lit(False)) | F.coalesce(c["ensemblGeneId"] == g, F.lit(False)) | F.coalesce(c["ensemblTranscriptId"] == g, F.lit(False))
    return _terms(F.filter(_col(annotation)["consequenceTypes"], keep))


def protein_substitution(annotation, source) -> Column:
    """[min, max] of a source's substitution scores over all consequences; [] where there is none."""
    scores = F.flatten(F.transform(_col(annotation)["consequenceTypes"], lambda c: F.coalesce(F.transform(F.filter(c["proteinVariantAnnotation"]["substitutionScores"], lambda s: s["source"] == _value(source)), lambda s: s["score"]), F.array().cast("array<double>"))))
    return F.when(F.size(scores) > 0, F.array(F.array_min(scores), F.array_max(scores))).otherwise(F.array().cast("array<double>"))


def _score(annotation, field: str, source) -> Column:
    return _first(_col(annotation)[field], lambda s: s["source"] == _value(source))["score"]


def functional(annotation, source) -> Column:
    return _score(annotation, "functionalScore", source)


def conservation(annotation, source) -> Column:
    return _score(annotation, "conservation", source)


def population_frequency(annotation, study_id, population) -> Column:
    """Alternate allele frequency in a population; 0 where it isn't listed."""
    hit = _first(_col(annotation)["populationFrequencies"], lambda p: (p["study"] == _value(study_id)) & (p["population"] == _value(population)))
    return F.coalesce(hit["altAlleleFreq"].cast("double"), F.lit(0.0))


def population_frequency_as_map(annotation) -> Column:
    """{study:population -> frequency}; of repeated keys the last counts."""
    listed = F.coalesce(_col(annotation)["populationFrequencies"], F.filter(_col(annotation)["populationFrequencies"], lambda _: F.lit(False)))
    pairs = F.transform(listed, lambda p: F.struct(F.concat(p["study"], F.lit(":"), p["population"]).alias("key"), p["altAlleleFreq"].cast("double").alias("value")))
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda y: y["key"] == x["key"]))
    return F.coalesce(F.map_from_entries(last), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>")))


def include(column, schema, fields: str) -> Column:
    """A struct with the fields that aren't listed set to null."""
    keep = {f.strip() for f in fields.split(",")}
    return F.struct(*((_col(column)[f.name] if f.name in keep else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields))


def include_studies(studies, names: str) -> Column:
    return F.filter(_col(studies), lambda s: s["studyId"].isin([n.strip() for n in names.split(",")]))


_A, _S = (
    "STRUCT<id:STRING,consequenceTypes:ARRAY<STRUCT<geneName:STRING,ensemblGeneId:STRING,ensemblTranscriptId:STRING,biotype:STRING,sequenceOntologyTerms:ARRAY<STRUCT<accession:STRING,name:STRING>>,proteinVariantAnnotation:STRUCT<substitutionScores:ARRAY<STRUCT<score:DOUBLE,source:STRING,description:STRING>>>>>,"
    "populationFrequencies:ARRAY<STRUCT<study:STRING,population:STRING,altAlleleFreq:FLOAT>>,conservation:ARRAY<STRUCT<score:DOUBLE,source:STRING,description:STRING>>,functionalScore:ARRAY<STRUCT<score:DOUBLE,source:STRING,description:STRING>>>",
    "studies",
)

#: SQL bodies by name: (parameters, return type, body). {A} and {S} are the types of annotation and studies.
SQL_FUNCTIONS = {
    "revcomp": ("allele STRING", "STRING", "translate(reverse(allele), 'ACGTacgt', 'TGCATGCA')"),
    "file_attribute": ("studies {S}, file_id STRING, name STRING", "STRING", "try_element_at(get(filter(flatten(transform(studies, s -> s.files)), f -> f.fileId = file_id), 0).attributes, name)"),
    "file_qual": ("studies {S}, file_id STRING", "DOUBLE", "try_cast(nullif(nullif(try_element_at(get(filter(flatten(transform(studies, s -> s.files)), f -> f.fileId = file_id), 0).attributes, 'QUAL'), '.'), '') AS DOUBLE)"),
    "file_filter": ("studies {S}, file_id STRING", "ARRAY<STRING>", "split(nullif(try_element_at(get(filter(flatten(transform(studies, s -> s.files)), f -> f.fileId = file_id), 0).attributes, 'FILTER'), ''), ';')"),
    "genes": ("annotation {A}", "ARRAY<STRING>", "array_sort(array_distinct(filter(annotation.consequenceTypes.geneName, g -> g <> '')))"),
    "ensembl_genes": ("annotation {A}", "ARRAY<STRING>", "array_sort(array_distinct(filter(annotation.consequenceTypes.ensemblGeneId, g -> g <> '')))"),
    "biotypes": ("annotation {A}", "ARRAY<STRING>", "array_sort(array_distinct(filter(annotation.consequenceTypes.biotype, g -> g <> '')))"),
    "consequence_types": ("annotation {A}", "ARRAY<STRING>", "array_sort(array_distinct(flatten(transform(annotation.consequenceTypes, c -> coalesce(c.sequenceOntologyTerms.name, array())))))"),
    "consequence_types_by_gene": ("annotation {A}, gene STRING", "ARRAY<STRING>", "array_sort(array_distinct(flatten(transform(filter(annotation.consequenceTypes, c -> gene = '' OR coalesce(c.geneName = gene, false) OR coalesce(c.ensemblGeneId = gene, false) OR coalesce(c.ensemblTranscriptId = gene, false)), c -> coalesce(c.sequenceOntologyTerms.name, array())))))"),
    "functional": ("annotation {A}, source STRING", "DOUBLE", "get(filter(annotation.functionalScore, s -> s.source = source), 0).score"),
    "conservation": ("annotation {A}, source STRING", "DOUBLE", "get(filter(annotation.conservation, s -> s.source = source), 0).score"),
    "population_frequency": ("annotation {A}, study STRING, population STRING", "DOUBLE", "coalesce(CAST(get(filter(annotation.populationFrequencies, p -> p.study = study AND p.population = population), 0).altAlleleFreq AS DOUBLE), 0.0D)"),
    "population_frequency_as_map": ("annotation {A}", "MAP<STRING,DOUBLE>", "map_from_entries(transform(annotation.populationFrequencies, p -> struct(concat(p.study, ':', p.population), CAST(p.altAlleleFreq AS DOUBLE))))"),
    "protein_substitution": ("annotation {A}, source STRING", "ARRAY<DOUBLE>", "transform(array(flatten(transform(annotation.consequenceTypes, c -> coalesce(transform(filter(c.proteinVariantAnnotation.substitutionScores, x -> x.source = source), x -> x.score), CAST(array() AS ARRAY<DOUBLE>))))), v -> if(size(v) > 0, array(array_min(v), array_max(v)), CAST(array() AS ARRAY<DOUBLE>)))[0]"),
    "study": ("studies {S}, study_id STRING", "{E}", "get(filter(studies, s -> s.studyId = study_id), 0)"),
    "file": ("studies {S}, file_id STRING", "{F}", "get(filter(flatten(transform(studies, s -> s.files)), f -> f.fileId = file_id), 0)"),
}


def register(spark: SparkSession, df: DataFrame) -> None:
    """Temporary SQL functions for the types of this DataFrame; Catalyst puts their bodies into the plan.

    genotype, sample_data and sample_data_field look a sample up in the DataFrame's metadata, whose sample
    order is compiled into the function as a map from study and sample to position.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    a, s = types["annotation"].simpleString(), types["studies"].simpleString()
    element, files = types["studies"].elementType, types["studies"].elementType["files"].dataType.elementType
    fill = {"{A}": a, "{S}": s, "{E}": element.simpleString(), "{F}": files.simpleString()}

    def create(name: str, parameters: str, returns: str, body: str) -> None:
        for k, v in fill.items():
            parameters, returns = parameters.replace(k, v), returns.replace(k, v)
        # a parameter is named apart from the struct fields that the body compares it with
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {returns} RETURN {body}")

    renamed = {"source": "wanted_source", "study": "wanted_study", "population": "wanted_population", "gene": "wanted_gene", "name": "wanted_name"}
    for name, (parameters, returns, body) in SQL_FUNCTIONS.items():
        names = [p.split()[0] for p in parameters.split(", ")]
        for old in names:
            if old in renamed:
                new = renamed[old]
                parameters = parameters.replace(f"{old} STRING", f"{new} STRING")
                body = _rename(body, old, new)
        create(name, parameters, returns, body)
    listed = "transform(split(wanted_names, ','), x -> trim(x))"
    fields = ", ".join(f"'{f.name}', IF(array_contains({listed}, '{f.name}'), annotation.`{f.name}`, NULL)" for f in types["annotation"].fields)
    create("include", "annotation {A}, wanted_names STRING", "{A}", f"named_struct({fields})")
    create("include_studies", "studies {S}, wanted_names STRING", "{S}", f"filter(studies, s -> array_contains({listed}, s.studyId))")
    places = [(st.id, m, i) for st in metadata_of(df).studies.values() for i, m in enumerate(st.samples)]
    quote = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    known = "map(" + ", ".join(f"{quote(x)}, map({', '.join(f'{quote(m)}, {i}' for y, m, i in places if y == x)})" for x in dict.fromkeys(p[0] for p in places)) + ")"
    data = f"filter(transform(studies, s -> get(s.samplesData, try_element_at(try_element_at({known}, s.studyId), wanted_sample))), d -> d IS NOT NULL)"
    create("sample_data", "studies {S}, wanted_sample STRING", "ARRAY<STRING>", f"get({data}, 0)")
    value = f"filter(transform(studies, s -> get(get(s.samplesData, try_element_at(try_element_at({known}, s.studyId), wanted_sample)), nullif(CAST(array_position(s.format, wanted_field) AS INT), 0) - 1)), d -> d IS NOT NULL)"
    create("sample_data_field", "studies {S}, wanted_sample STRING, wanted_field STRING", "STRING", f"get({value}, 0)")
    create("genotype", "studies {S}, wanted_sample STRING", "STRING", f"get({value.replace('wanted_field', quote('GT'))}, 0)")


def _rename(body: str, old: str, new: str) -> str:
    """Replaces a bare name where it stands as the right side of a comparison or as an argument of its own."""
    import re

    return re.sub(rf"(= |, |^)(?<!\.){old}\b(?! ->)|(?<![\w.]){old}(?= = '')", lambda m: (m.group(1) or "") + new, body)
