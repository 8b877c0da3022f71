"""XML sources: drug dumps, product labels and literature records."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from apothecary.functions import rules
from apothecary.functions.text import clean

_DRUG = (
    """_type string, `drugbank-id` array<struct<_VALUE string, _primary string>>, name string, description string, indication string, `mechanism-of-action` string,
    `half-life` string, `protein-binding` string, groups struct<`group` array<string>>, synonyms struct<synonym array<struct<_VALUE string>>>,
    `drug-interactions` struct<`drug-interaction` array<struct<`drugbank-id` string, name string, description string>>>,
    enzymes struct<enzyme array<struct<name string, actions struct<action array<string>>>>>,
    `calculated-properties` struct<property array<struct<kind string, value string>>>,
    `external-identifiers` struct<`external-identifier` array<struct<resource string, identifier string>>>"""
)
#: Codes of label sections: fixed values.
SECTION_CODES = {
    "34066-1": "boxed_warning",
    "43685-7": "warnings_and_precautions",
    "34084-4": "adverse_reactions",
    "34073-7": "drug_interactions",
    "34070-3": "contraindications",
    "34068-7": "dosage_and_administration",
    "34089-3": "description",
    "43679-0": "mechanism_of_action",
    "34090-1": "clinical_pharmacology",
    "34092-7": "clinical_studies",
}
_ENZYME = r"(?i)CYP\s?(1A2|2B6|2C8|2C9|2C19|2D6|2E1|3A4|3A5)"


def system_codes(document: Column, system: str) -> Column:
    """The different codes, sorted, of all elements of an XML text whose ``codeSystem`` is the given object identifier.

    Elements without a code, or with an empty one, give none; a null document
    gives an empty array; text that is no XML is an error of the query.
    """
    if not system.replace(".", "").replace("-", "").isalnum():
        raise ValueError(f"no object identifier: {system}")
    found = F.xpath(document, F.lit(f"//*[@codeSystem='{system}']/@code"))
    return F.coalesce(F.array_sort(F.array_distinct(F.filter(found, lambda c: c != ""))), F.array().cast("array<string>"))


def read_drugs(spark: SparkSession, path: str) -> DataFrame:
    """Small molecules and biotech drugs with a primary id and a name, nested parts kept as arrays."""
    df = spark.read.format("xml").option("rowTag", "drug").schema(_DRUG).load(path).where(F.col("_type").isin("small molecule", "biotech"))
    ids = F.filter("drugbank-id", lambda x: x["_primary"] == "true")
    of = lambda kind: F.try_element_at(F.filter(F.transform(F.filter("calculated-properties.property", lambda p: p["kind"] == kind), lambda p: p["value"].try_cast("double")), lambda v: v.isNotNull()), F.lit(-1))
    rxnorm = F.filter("external-identifiers.external-identifier", lambda x: x["resource"] == "RxCUI")
    return df.select(
        F.get(ids, F.lit(0))["_VALUE"].alias("drug_id"), F.trim("name").alias("name"), F.col("_type").alias("drug_type"), "description", "indication",
        F.col("mechanism-of-action").alias("mechanism"), F.col("half-life").alias("half_life"), F.col("protein-binding").alias("protein_binding"),
        F.col("groups.group").alias("groups"), F.transform("synonyms.synonym", lambda s: s["_VALUE"]).alias("synonyms"),
        of("Molecular Weight").alias("molecular_weight"), of("logP").alias("logp"), F.get(rxnorm, F.lit(0))["identifier"].alias("rxnorm_id"),
        F.col("drug-interactions.drug-interaction").alias("interactions"), F.col("enzymes.enzyme").alias("enzymes"),
    ).where("drug_id is not null and name <> ''")


def interactions(drugs: DataFrame) -> DataFrame:
    """One row a listed interaction, with the severity that its description shows."""
    rows = drugs.select("drug_id", "name", F.explode("interactions").alias("x"))
    return rows.select(F.col("drug_id").alias("drug_a_id"), F.col("name").alias("drug_a"), F.col("x.drugbank-id").alias("drug_b_id"), F.col("x.name").alias("drug_b"), F.col("x.description").alias("description"), rules.severity_of_text(F.coalesce("x.description", F.lit(""))).alias("severity"))


def enzyme_roles(drugs: DataFrame) -> DataFrame:
    """drug, enzyme and role; an action such as ``inhibitor/substrate`` gives a row for each role."""
    rows = drugs.select("name", F.explode("enzymes").alias("e")).select("name", F.regexp_extract("e.name", _ENZYME, 1).alias("found"), F.explode("e.actions.action").alias("action"))
    roles = F.filter(F.array(*map(F.lit, ("substrate", "inhibitor", "inducer"))), lambda r: F.contains(F.lower("action"), r))
    return rows.where("found <> ''").select(F.col("name").alias("drug"), F.concat(F.lit("CYP"), F.upper("found")).alias("enzyme"), F.explode(roles).alias("role")).distinct()


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """Literature records with an id and an abstract; labelled abstract parts are joined as ``Label: text``."""
    schema = (
        """MedlineCitation struct<PMID struct<_VALUE string>, Article struct<ArticleTitle string, Abstract struct<AbstractText array<struct<_Label string, _VALUE string>>>,
        Journal struct<Title string, JournalIssue struct<PubDate struct<Year string, MedlineDate string>>>,
        AuthorList struct<Author array<struct<LastName string, ForeName string>>>>, MeshHeadingList struct<MeshHeading array<struct<DescriptorName struct<_VALUE string>>>>>"""
    )
    c = F.col("MedlineCitation")
    part = lambda p: F.when(p["_Label"].isNotNull(), F.concat(p["_Label"], F.lit(": "), p["_VALUE"])).otherwise(p["_VALUE"])
    date = c["Article"]["Journal"]["JournalIssue"]["PubDate"]
    df = spark.read.format("xml").option("rowTag", "PubmedArticle").schema(schema).load(path)
    return df.select(
        F.trim(c["PMID"]["_VALUE"]).alias("pmid"), c["Article"]["ArticleTitle"].alias("title"),
        F.array_join(F.transform(c["Article"]["Abstract"]["AbstractText"], part), " ").alias("abstract"), c["Article"]["Journal"]["Title"].alias("journal"),
        F.coalesce(date["Year"], F.left(date["MedlineDate"], F.lit(4))).alias("year"),
        F.transform(c["Article"]["AuthorList"]["Author"], lambda a: F.concat_ws(" ", a["LastName"], a["ForeName"])).alias("authors"),
        F.transform(c["MeshHeadingList"]["MeshHeading"], lambda m: m["DescriptorName"]["_VALUE"]).alias("mesh_terms"),
    ).where("pmid <> '' and abstract <> ''").dropDuplicates(["pmid"])


def _sections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Coded sections of each label document in reading order; the text of a nested section is in its parent's too."""
    from xml.etree import ElementTree

    for batch in batches:
        out: list[tuple] = []
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            try:
                root = ElementTree.fromstring(content)
            except ElementTree.ParseError:
                continue
            space = root.tag.partition("}")[0] + "}" if root.tag.startswith("{") else ""
            names = (root.find(f".//{space}manufacturedProduct/{space}name"), root.find(f".//{space}genericMedicine/{space}name"), root.find(f"./{space}title"))
            name = next((" ".join(e.itertext()).strip() for e in names if e is not None and " ".join(e.itertext()).strip()), "")
            set_id = root.find(f"./{space}setId")
            for place, section in enumerate(root.iter(f"{space}section")):
                code = section.find(f"./{space}code")
                if name and code is not None:
                    out.append((path, set_id.get("root") if set_id is not None else None, name, place, code.get("code"), " ".join(section.itertext())))
        columns = list(zip(*out, strict=True)) or [()] * 6
        types = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["path", "set_id", "drug_name", "place", "code", "text"])


def read_labels(spark: SparkSession, path: str, least: int = 40) -> DataFrame:
    """set_id, drug_name, section and text of product labels under a folder; parts of one section are joined by an empty line.

    Files that are no XML or name no drug are left out, as are sections of
    unknown code or under ``least`` letters.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.xml").load(path)
    rows = files.select("path", "content").mapInArrow(_sections, "path string, set_id string, drug_name string, place int, code string, text string")
    codes = F.create_map(*[F.lit(x) for item in SECTION_CODES.items() for x in item])
    rows = rows.withColumn("section", F.element_at(codes, F.col("code"))).withColumn("text", clean(F.col("text"))).where(F.col("section").isNotNull() & (F.length("text") >= least))
    parts = F.array_sort(F.collect_list(F.struct("place", "text")))
    return rows.groupBy("path", "set_id", "drug_name", "section").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n").alias("text"))
