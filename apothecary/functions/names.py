"""Drug and source names: normal forms, dose stripping, aliases and document links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Citation prefix of each source: fixed values.
PREFIXES = {"dailymed": "FDA", "fda": "FDA", "faers": "FAERS", "pubmed": "PUB", "pmid": "PUB", "drugbank": "DB", "rxnorm": "RXN"}
#: Shown name of each source: fixed values.
LABELS = {"dailymed": "FDA DailyMed", "fda": "FDA DailyMed", "faers": "FDA FAERS", "pubmed": "PubMed", "pmid": "PubMed", "drugbank": "DrugBank", "rxnorm": "RxNorm"}
#: Other spellings of sources: fixed values.
SOURCE_ALIASES = {"daily_med": "dailymed", "daily-med": "dailymed", "label": "dailymed", "fda_label": "dailymed", "pmc": "pubmed", "pub_med": "pubmed"}
#: Strengths and dose forms that are no part of a name: a fixed value.
DOSE_WORDS = r"\b(\d+\s*(?:mg|mcg|g|ml|%|units?|iu|meq|mmol)|oral|tablet|capsule|injection|solution|extended.release|er|xr|sr|cr|dr|hcl|hydrochloride|sodium|potassium|film.coated|delayed.release|modified.release)\b"
#: From a strength, or a word of frequency, to the end of a name: fixed values.
STRENGTH_TAIL = r"\d+\.?\d*\s*(mg|mcg|g|ml|units?|iu|%)\b.*$"
FREQUENCY_TAIL = r"\s+(daily|twice|tid|qid|bid|once|weekly|prn|as needed).*$"
#: Generic names of brands: fixed values.
GENERIC_NAMES = {
    "tylenol": "acetaminophen", "advil": "ibuprofen", "motrin": "ibuprofen", "aleve": "naproxen", "coumadin": "warfarin", "zocor": "simvastatin", "lipitor": "atorvastatin", "prozac": "fluoxetine",
    "zoloft": "sertraline", "paxil": "paroxetine", "xanax": "alprazolam", "valium": "diazepam", "lasix": "furosemide", "glucophage": "metformin", "glucophage xr": "metformin", "crestor": "rosuvastatin",
    "norvasc": "amlodipine", "zithromax": "azithromycin", "biaxin": "clarithromycin", "cipro": "ciprofloxacin", "augmentin": "amoxicillin-clavulanate", "bactrim": "trimethoprim-sulfamethoxazole",
    "prinivil": "lisinopril", "zestril": "lisinopril", "toprol": "metoprolol", "lopressor": "metoprolol",
}


def drug_name(name: Column) -> Column:
    return F.regexp_replace(F.upper(F.trim(name)), r"\s+", " ")


def without_dose(name: Column) -> Column:
    """Lower-case name without brackets, strengths and dose forms; the name itself if under two letters are left."""
    bare = F.regexp_replace(F.trim(name), r"\(.*?\)", "")
    bare = F.regexp_replace(bare, "(?i)" + DOSE_WORDS, " ")
    bare = F.lower(F.trim(F.regexp_replace(bare, r"\s+", " ")))
    return F.when(F.length(bare) < 2, F.lower(F.trim(name))).otherwise(bare)


def generic_name(name: Column) -> Column:
    """Lower-case name up to its strength or frequency, brands as their generic names."""
    bare = F.trim(F.regexp_replace(F.lower(name), STRENGTH_TAIL, ""))
    bare = F.trim(F.regexp_replace(bare, FREQUENCY_TAIL, ""))
    table = F.create_map(*[F.lit(x) for item in GENERIC_NAMES.items() for x in item])
    return F.coalesce(F.element_at(table, bare), bare)


def _looked_up(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for item in table.items() for x in item]), key)


def source_family(source: Column) -> Column:
    """The lower-case source, aliases as what they stand for; ``unknown`` where there is none."""
    key = F.lower(F.trim(F.coalesce(source, F.lit(""))))
    return F.coalesce(_looked_up(SOURCE_ALIASES, key), F.when(key == "", F.lit("unknown")).otherwise(key))


def citation_prefix(source: Column) -> Column:
    return F.coalesce(_looked_up(PREFIXES, source_family(source)), F.lit("SRC"))


def source_label(source: Column) -> Column:
    """The shown name of a source; of others the name as it came, in capitals, or ``Source``."""
    named = F.upper(F.coalesce(source, F.lit("")))
    return F.coalesce(_looked_up(LABELS, source_family(source)), F.when(named == "", F.lit("Source")).otherwise(named))


def document_url(source: Column, doc_id: Column, existing: Column) -> Column:
    """The URL at hand, else one made from the source's document id; empty if neither."""
    family, bare = source_family(source), F.trim(F.coalesce(doc_id, F.lit("")))
    number = F.regexp_extract(bare, r"(?i)\b(?:pmid[:\s]*)?(\d{6,9})\b", 1)
    pubmed = F.when(number != "", number).when(bare.rlike(r"^\d+$"), bare)
    return (
        F.when(F.coalesce(existing, F.lit("")) != "", existing)
        .when((family == "pubmed") & pubmed.isNotNull(), F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), pubmed, F.lit("/")))
        .when((family == "drugbank") & F.upper(bare).startswith("DB"), F.concat(F.lit("https://go.drugbank.com/drugs/"), bare))
        .when((family == "dailymed") & (bare != ""), F.concat(F.lit("https://dailymed.nlm.nih.gov/dailymed/drugInfo.cfm?setid="), bare))
        .otherwise("")
    )


def citation_identity(source: Column, doc_id: Column, section: Column, chunk_id: Column, text: Column | None = None) -> Column:
    """The same for two chunks of one section of one document, whatever the case; chunks without a document go by their id as it is, or by their text."""
    part = lambda c: F.trim(F.coalesce(c.cast("string"), F.lit("")))
    chunk = F.coalesce(chunk_id.cast("string"), F.lit(""))
    digest = F.left(F.sha1(F.coalesce(F.lit("") if text is None else text, F.lit("")).cast("binary")), F.lit(16))
    return (
        F.when(part(doc_id) != "", F.concat_ws("|", source_family(source), F.lower(part(doc_id)), F.upper(part(section))))
        .when(chunk != "", F.concat_ws("|", source_family(source), F.lit("chunk"), chunk))
        .otherwise(F.concat_ws("|", source_family(source), F.lit("text"), digest))
    )
