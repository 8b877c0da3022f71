"""Text cleaning, chunking, dedup and citations over documents, pages, part and conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from apothecary.functions import names, text
from apothecary.operators import citations, dedup
from apothecary.operators.quantiles import exact_quantiles
from apothecary.sources.tables import table


def _clean_sql(column: str) -> str:
    return f"trim(regexp_replace(regexp_replace({column}, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', ' ', 'g'), '\\s+', ' ', 'g'), ' ')"


def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = text.clean(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(cleaned).cast("long").alias("n_clean"), F.sha1(cleaned.cast("binary")).alias("clean_sha1"))


def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    abbreviated = F.concat(text.clean(F.col("text")), F.lit(" Seen by Prof. Ba, i.e. One, in the U.S. Army etc. By Ms. Lo. "), F.lit("approx. Two e.g. Three"))
    both = F.transform(F.array(text.sentences(abbreviated)), lambda s: F.struct(F.size(s).cast("long").alias("n_sentences"), F.try_element_at(s, F.lit(-1)).alias("last_sentence")))
    return table(spark, sf_dir, "documents").select("doc_id", F.inline(both))


_SENTENCE_SQL = rf"""
WITH g AS (SELECT doc_id, regexp_replace({_clean_sql("text")} || ' Seen by Prof. Ba, i.e. One, in the U.S. Army etc. By Ms. Lo. approx. Two e.g. Three', '{text.ABBREVIATION_PATTERN}', '\1' || chr(1), 'g') AS t FROM documents),
     s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(t, '([.!?])\s+([A-Z])', '\1' || chr(2) || '\2', 'g'), chr(2)), lambda x: trim(replace(x, chr(1), '.'))), lambda x: x <> '') AS l FROM g)
SELECT doc_id, len(l) AS n_sentences, l[-1] AS last_sentence FROM s
"""


def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of every document with their length, token estimate and hash."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(text.chunks(text.clean(F.col("text")))).alias("place", "chunk"))
    return rows.select("doc_id", "source", "place", F.length("chunk").alias("char_count"), text.token_estimate(F.col("chunk")).alias("token_estimate"), text.content_hash(F.col("chunk")).alias("content_hash"))


_CHUNK_SQL = rf"""
WITH RECURSIVE g AS (SELECT doc_id, source, {_clean_sql("text")} AS t FROM documents),
 s AS (SELECT doc_id, source, t, list_filter(list_transform(string_split(regexp_replace(regexp_replace(t, '{text.ABBREVIATION_PATTERN}', '\1' || chr(1), 'g'), '([.!?])\s+([A-Z])', '\1' || chr(2) || '\2', 'g'), chr(2)), lambda x: trim(replace(x, chr(1), '.'))), lambda x: x <> '') AS l FROM g),
 f AS (SELECT doc_id, 0 AS i, CAST([] AS VARCHAR[]) AS done, CAST([] AS VARCHAR[]) AS o FROM s WHERE length(t) > 1400
  UNION ALL SELECT doc_id, i + 1,
   CASE WHEN len(o) > 0 AND (length(array_to_string(o, '')) + length(l[i + 1]) > 1400 OR length(array_to_string(o, '')) >= 1000) THEN list_append(done, array_to_string(o, ' ')) ELSE done END,
   CASE WHEN len(o) > 0 AND (length(array_to_string(o, '')) + length(l[i + 1]) > 1400 OR length(array_to_string(o, '')) >= 1000) THEN [o[-1], l[i + 1]] ELSE list_append(o, l[i + 1]) END
  FROM f JOIN s USING (doc_id) WHERE i < len(l)),
 c AS (SELECT doc_id, source, [t] AS c FROM s WHERE length(t) <= 1400
  UNION ALL SELECT doc_id, source, CASE WHEN len(o) > 0 THEN list_append(done, array_to_string(o, ' ')) ELSE done END FROM f JOIN s USING (doc_id) WHERE i = len(l)),
 k AS (SELECT doc_id, source, list_filter(c, lambda x: length(x) >= 80) AS c FROM c),
 e AS (SELECT doc_id, source, unnest(c) AS chunk, generate_subscripts(c, 1) AS p FROM k)
SELECT doc_id, source, CAST(p - 1 AS INTEGER) AS place, length(chunk) AS char_count, CAST(greatest(1, length(chunk) // 4) AS INTEGER) AS token_estimate, sha1(lower(chunk)) AS content_hash FROM e
"""


def exact_text_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.one_of_each_text(table(spark, sf_dir, "documents"), "text", [F.col("doc_id")]).select("doc_id", "lang", "source")


_DEDUP_SQL = "SELECT doc_id, lang, source FROM documents QUALIFY row_number() OVER (PARTITION BY sha1(lower(text)) ORDER BY doc_id) = 1"


def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("source", "lang", F.length("text").cast("double").alias("n"))
    sums = rows.groupBy("source").agg(F.count("*").alias("n_docs"), F.count_if(F.col("lang") == "en").alias("n_english"), F.min("n").alias("least"), F.max("n").alias("most"), F.sum(F.col("n").cast("long")).alias("total"))
    cuts = exact_quantiles(rows, {"q25": ("n", 0.25), "q50": ("n", 0.5), "q75": ("n", 0.75)}, by=("source",)).withColumnRenamed("source", "_source")
    joined = sums.join(cuts, F.col("source").eqNullSafe(F.col("_source")))
    return joined.select("source", "n_docs", "n_english", "least", "q25", "q50", "q75", "most", "total")


_STATS_SQL = """
SELECT source, count(*) AS n_docs, count(*) FILTER (lang = 'en') AS n_english, CAST(min(length(text)) AS DOUBLE) AS least, quantile_cont(CAST(length(text) AS DOUBLE), 0.25) AS q25,
  quantile_cont(CAST(length(text) AS DOUBLE), 0.5) AS q50, quantile_cont(CAST(length(text) AS DOUBLE), 0.75) AS q75, CAST(max(length(text)) AS DOUBLE) AS most, CAST(sum(length(text)) AS BIGINT) AS total
FROM documents GROUP BY source
"""


def batched_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of each brand in batches of fifteen, rendered as a line."""
    parts = table(spark, sf_dir, "part").select("p_brand", "p_name").distinct()
    numbered = dedup.ranked(parts, ["p_brand"], [F.col("p_name")])
    batch = F.floor((F.col("rank") - 1) / 15).cast("int").alias("batch")
    grouped = numbered.groupBy("p_brand", batch).agg(F.array_sort(F.collect_list("p_name")).alias("listed"))
    return grouped.select("p_brand", "batch", F.concat("p_brand", F.lit(" metabolises "), F.array_join("listed", ", ")).alias("line"))


_BATCH_SQL = """
WITH d AS (SELECT DISTINCT p_brand, p_name FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_name) AS r FROM d)
SELECT p_brand, CAST((r - 1) // 15 AS INTEGER) AS batch, p_brand || ' metabolises ' || string_agg(p_name, ', ' ORDER BY p_name) AS line FROM n GROUP BY 1, 2
"""


def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of a page without tags, scripts and styles."""
    bare = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), "(?s)<[^>]*>", " ")
    flat = text.clean(bare)
    return table(spark, sf_dir, "pages").select("page_id", F.length(flat).cast("long").alias("n_text"), F.sha1(flat.cast("binary")).alias("text_sha1"))


_HTML_SQL = rf"""
WITH b AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g') AS t FROM pages)
SELECT page_id, length({_clean_sql("t")}) AS n_text, sha1({_clean_sql("t")}) AS text_sha1 FROM b
"""


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    family = F.element_at(F.array(*map(F.lit, ("Daily-Med", "FAERS", "PMC", "drugbank", "web"))), (F.col("doc_id") % 5 + 1).cast("int"))
    return docs.select(F.col("lang").alias("query"), family.alias("source"), F.floor(F.col("doc_id") / 3).cast("string").alias("doc_id"), F.col("source").alias("section"), F.col("doc_id").alias("chunk_id"), F.length("text").alias("relevance"))


_CHUNKS_SQL = """
chunks AS (SELECT lang AS query, (['dailymed', 'faers', 'pubmed', 'drugbank', 'web'])[doc_id % 5 + 1] AS family, (['FDA', 'FAERS', 'PUB', 'DB', 'SRC'])[doc_id % 5 + 1] AS prefix,
  CAST(doc_id // 3 AS VARCHAR) AS doc, source AS section, doc_id AS chunk_id, length(text) AS relevance FROM documents)
"""


def citation_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citations.citation_keys(_chunks(spark, sf_dir), "query", "chunk_id").select("query", "identity", "key", F.col("relevance").cast("long").alias("relevance"), "n_chunks")


_KEYS_SQL = f"""
WITH {_CHUNKS_SQL}, m AS (SELECT query, prefix, family || '|' || doc || '|' || upper(section) AS identity, min(chunk_id) AS first_seen, max(relevance) AS relevance, count(*) AS n_chunks FROM chunks GROUP BY 1, 2, 3)
SELECT query, identity, prefix || '-' || row_number() OVER (PARTITION BY query, prefix ORDER BY first_seen, identity) AS key, relevance, n_chunks FROM m
"""


_SPELLINGS = ("Daily-Med", "daily_med", " LABEL ", "fda_label", "FDA", "PMC", "pub_med", "PMID", "My-Src", "")


def source_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Family, prefix, shown name and identity of documents under many spellings of sources, some without an id or a chunk."""
    number = F.col("doc_id")
    source = F.element_at(F.array(*map(F.lit, _SPELLINGS)), (number % 10 + 1).cast("int"))
    doc, chunk = F.when(number % 3 == 0, F.concat(F.lit(" Doc"), number.cast("string"))), F.when(number % 3 == 1, F.concat(F.lit("Chunk"), number.cast("string")))
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        names.source_family(source).alias("family"),
        names.citation_prefix(source).alias("prefix"),
        names.source_label(source).alias("label"),
        names.citation_identity(source, doc, F.col("source"), chunk, F.col("text")).alias("identity"),
    )


_SOURCE_NAMES_SQL = """
WITH s AS (SELECT *, (['dailymed', 'dailymed', 'dailymed', 'dailymed', 'fda', 'pubmed', 'pubmed', 'pmid', 'my-src', 'unknown'])[doc_id % 10 + 1] AS family FROM documents)
SELECT doc_id, family, (['FDA', 'FDA', 'FDA', 'FDA', 'FDA', 'PUB', 'PUB', 'PUB', 'SRC', 'SRC'])[doc_id % 10 + 1] AS prefix,
  (['FDA DailyMed', 'FDA DailyMed', 'FDA DailyMed', 'FDA DailyMed', 'FDA DailyMed', 'PubMed', 'PubMed', 'PubMed', 'MY-SRC', 'Source'])[doc_id % 10 + 1] AS label,
  CASE doc_id % 3 WHEN 0 THEN family || '|doc' || doc_id || '|' || upper(trim(source)) WHEN 1 THEN family || '|chunk|Chunk' || doc_id ELSE family || '|text|' || left(sha1(coalesce(text, '')), 16) END AS identity FROM s
"""


def citation_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys cited in each conversation's assistant turns against keys its user turns gave."""
    turns = table(spark, sf_dir, "conversations").withColumn("key", F.concat(F.lit("DB-"), (F.length("text") % 7).cast("string")))
    grouped = turns.groupBy("conv_id").agg(F.array_join(F.collect_list(F.when(F.col("role") == "assistant", F.concat(F.lit("["), "key", F.lit("]")))), " ").alias("reply"), F.collect_set(F.when(F.col("role") == "user", F.col("key"))).alias("known"))
    checks = citations.compare_cited(citations.cited_keys(F.col("reply")), F.col("known"))
    return grouped.select("conv_id", *[F.array_join(c, ",").alias(n) for n, c in checks.items()])


_CHECKS_SQL = """
WITH t AS (SELECT conv_id, role, 'DB-' || (length(text) % 7) AS key FROM conversations),
     g AS (SELECT conv_id, coalesce(list(DISTINCT key) FILTER (role = 'assistant'), []) AS cited, coalesce(list(DISTINCT key) FILTER (role = 'user'), []) AS known FROM t GROUP BY 1)
SELECT conv_id, array_to_string(list_sort(list_filter(cited, lambda x: NOT list_contains(known, x))), ',') AS unknown, array_to_string(list_sort(list_filter(known, lambda x: NOT list_contains(cited, x))), ',') AS unused FROM g
"""


def display_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of each language in display order."""
    sections = F.element_at(F.array(*map(F.lit, ("boxed_warning", "CONTRAINDICATIONS", "drug_interactions", "summary"))), (F.col("chunk_id") % 4 + 1).cast("int"))
    rows = _chunks(spark, sf_dir).withColumn("section", sections)
    source, section = citations.display_place(names.source_family(F.col("source")), F.col("section"))
    rows = rows.withColumns({"source_place": source, "section_place": section})
    return dedup.ranked(rows, ["query"], [F.col("source_place"), F.col("section_place"), F.col("chunk_id")], "place").select("query", "chunk_id", "source_place", "section_place", "place")


_DISPLAY_SQL = """
WITH r AS (SELECT lang AS query, doc_id AS chunk_id, ([0, 1, 2, 3, 9])[doc_id % 5 + 1] AS source_place, ([1, 2, 4, 99])[doc_id % 4 + 1] AS section_place FROM documents)
SELECT *, row_number() OVER (PARTITION BY query ORDER BY source_place, section_place, chunk_id) AS place FROM r
"""


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.snippet(F.col("text")).alias("snippet"))


_SNIPPET_SQL = f"""
WITH c AS (SELECT doc_id, {_clean_sql("text")} AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) <= 280 THEN t ELSE rtrim(t[1:279], ' ') || '...' END AS snippet FROM c
"""


def json_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON objects found again in fenced replies, and one of their fields."""
    reply = F.concat(F.lit("Here you are:\n```json\n"), F.col("props"), F.lit("\n```"))
    found = text.json_object(reply)
    return table(spark, sf_dir, "events").select("event_id", found.alias("found"), F.get_json_object(found, "$.k").try_cast("long").alias("k"), text.without_null_words(F.col("event_type")).alias("event_type"))


_JSON_SQL = "SELECT event_id, props AS found, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type FROM events"


#: Tails that tell the strengths and forms apart: each part gets one.
_DOSED = ("(EC) 81 mg oral tablets", "HCl 25 mEq film-coated", "potassium 5 mmol/l", "500mg extended-release capsule", "2.5 mcg cream", "10 % solution er", "dr 40", "sodium (as salt) 3 units")


def _tail(key: str, texts: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, texts)), (F.col(key) % len(texts) + 1).cast("int"))


def dose_stripping(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    dosed = F.concat(F.initcap("p_name"), F.lit(" "), _tail("p_partkey", _DOSED))
    return parts.select("p_partkey", names.without_dose(dosed).alias("bare"), names.without_dose(_tail("p_partkey", _DOSED)).alias("bare_tail"), names.drug_name(F.concat(F.lit("  "), "p_name", F.lit("  x"))).alias("upper_name"))


def _bare_sql(name: str) -> str:
    bare = rf"lower(trim(regexp_replace(regexp_replace(regexp_replace(trim({name}), '\(.*?\)', '', 'g'), '(?i){names.DOSE_WORDS}', ' ', 'g'), '\s+', ' ', 'g')))"
    return f"CASE WHEN length({bare}) < 2 THEN lower(trim({name})) ELSE {bare} END"


_DOSE_SQL = rf"""
WITH p AS (SELECT p_partkey, p_name, ({list(_DOSED)!r})[p_partkey % {len(_DOSED)} + 1] AS tail FROM part)
SELECT p_partkey, {_bare_sql("p_name || ' ' || tail")} AS bare, {_bare_sql("tail")} AS bare_tail, regexp_replace(upper(trim('  ' || p_name || '  x')), '\s+', ' ', 'g') AS upper_name FROM p
"""

QUERIES = {
    "q15_clean_text": clean_text,
    "q16_sentence_counts": sentence_counts,
    "q17_chunk_documents": chunk_documents,
    "q18_exact_text_dedup": exact_text_dedup,
    "q19_chunk_stats": chunk_stats,
    "q21_batched_lists": batched_lists,
    "q22_html_text": html_text,
    "q31_citation_keys": citation_keys,
    "q91_source_names": source_names,
    "q32_citation_checks": citation_checks,
    "q33_display_order": display_order,
    "q41_dose_stripping": dose_stripping,
    "q56_json_recovery": json_recovery,
    "q58_snippets": snippets,
}
SQL = {
    "q15_clean_text": f"SELECT doc_id, length({_clean_sql('text')}) AS n_clean, sha1({_clean_sql('text')}) AS clean_sha1 FROM documents",
    "q16_sentence_counts": _SENTENCE_SQL,
    "q17_chunk_documents": _CHUNK_SQL,
    "q18_exact_text_dedup": _DEDUP_SQL,
    "q19_chunk_stats": _STATS_SQL,
    "q21_batched_lists": _BATCH_SQL,
    "q22_html_text": _HTML_SQL,
    "q31_citation_keys": _KEYS_SQL,
    "q91_source_names": _SOURCE_NAMES_SQL,
    "q32_citation_checks": _CHECKS_SQL,
    "q33_display_order": _DISPLAY_SQL,
    "q41_dose_stripping": _DOSE_SQL,
    "q56_json_recovery": _JSON_SQL,
    "q58_snippets": _SNIPPET_SQL,
}
