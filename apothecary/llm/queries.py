"""The registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apothecary.llm import ann, chat, fingerprints, html_wrappers, jaccard, packing, periodic_runs, prefix_trie, quality, secrets, sentencepieces, suffix_dedup, token_counts
from apothecary.llm.common import public_tokenizer, stored, table


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest_neighbours(vectors, vectors.where("vec_id % 50 = 0"))


_PROBE = "</s>[INST] ok [/INST]"


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every figure is read back from the formatted conversation."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", _PROBE), (-1, 1, "assistant", _PROBE)], "conv_id long, turn long, role string, text string")
    turns = turns.unionByName(probe).withColumn("parts", chat.text_parts(F.col("text")))
    made = chat.format_conversations(turns)
    made = made.withColumn("read", chat.read_back(F.col("formatted"))).withColumn("loss", F.array_join(chat.under_loss(F.col("formatted"), F.col("loss_spans")), ""))
    lines = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return made.select(
        "conv_id",
        F.size("read").cast("long").alias("n_turns"),
        F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _sql_escaped(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for control in chat.CONTROLS:
        out = f"replace({out}, '{control}', '{control[0]}\\{control[1:]}')"
    return out


OP2_SQL = f"""
WITH turns AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{_PROBE}'), (-1, 1, 'assistant', '{_PROBE}')
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(chat.TURN + chat.BODY + chat.END)} + length({_sql_escaped("role")}) + length({_sql_escaped("text")})) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, decoded again: a digest of the ids and whether the text came back."""
    path = public_tokenizer("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return sentencepieces.encoded_and_decoded(docs, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_pieces"),
        F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        (F.col("decoded") == F.translate("text", "▁", " ")).alias("round_trip"),
    )


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrappers.extract_main_text(table(spark, sf_dir, "pages"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(table(spark, sf_dir, "documents"), public_tokenizer("byte_bpe_50k.json"))
    return packing.pack(pieces)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizer("byte_bpe_50k.json"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_groups(table(spark, sf_dir, "documents"))


def op10_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents")).drop("edited")


def _with_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text; where the checksum of doc_id ends in 0, words from the a-th on repeat p words."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    docs = docs.withColumn("words", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))))
    docs = docs.withColumn("n", F.coalesce(F.size("words"), F.lit(0))).withColumn("g", F.expr("h div 10"))
    docs = docs.withColumn("a", F.when(F.col("n") > 0, (F.col("g") % F.col("n")).cast("int"))).withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    repeats = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.expr("cast((n - a + p - 1) div p as int)")))
    edited = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(repeats, F.lit(1), F.col("n") - F.col("a"))), " ")
    return docs.select("doc_id", F.when(F.col("n") > 0, edited).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(_with_periods(table(spark, sf_dir, "documents")))
    line = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    found = found.withColumn("top", top).select("*", F.col("top.length").alias("length"), (-F.col("top.start")).alias("start"), (-F.col("top.period")).alias("period"))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "start",
        "length",
        "period",
        F.expr("1000 * length div period").alias("exponent_milli"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    kinds = [rule.kind for rule in secrets.BASE]

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")

    def only(*names):
        return F.filter("spans", lambda s: s["kind"].isin(*names))

    counts = [F.size(only(kind)).cast("long").alias(f"n_{kind}") for kind in kinds]
    base = only(*kinds)
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def _rebuilt(lists: DataFrame) -> DataFrame:
    """Of conversation c the first h turns of c - c % 100, then its own after its first h."""
    heads = lists.where("conv_id % 100 = 0").select(F.col("conv_id").alias("base"), F.slice("turns", 1, 5).alias("head"))
    lists = lists.withColumn("base", F.expr("conv_id - conv_id % 100")).withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int"))
    head = F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), F.col("h"))
    return lists.join(heads, "base", "left").select("conv_id", F.concat(head, F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = stored(prefix_trie.turn_lists(table(spark, sf_dir, "conversations")))
    nodes, ends = prefix_trie.prefix_trie(_rebuilt(lists))
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    nodes = nodes.join(prefix_trie.ends_digests(ends), "key", "left")
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"))


_SQL_CRC = """xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(range(1, length(s) + 1), lambda i: [CAST(ascii(s[i]) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
    lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))))"""

OP13_SQL = f"""
WITH own AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS l
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), keyed AS (SELECT conv_id, {_SQL_CRC} % 6 AS h FROM (SELECT conv_id, CAST(conv_id AS VARCHAR) AS s FROM own)),
rebuilt AS (
  SELECT o.conv_id, list_concat(coalesce(b.l, [])[1:h], o.l[h + 1:]) AS l
  FROM own o JOIN keyed USING (conv_id) LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 100
), nodes AS (
  SELECT d AS depth, l[1:d] AS k, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(l) = d), '')) AS ends_sha256
  FROM rebuilt, unnest(range(0, len(l) + 1)) AS u(d) GROUP BY d, l[1:d]
), children AS (SELECT depth - 1 AS depth, k[1:depth - 1] AS k, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
weighed AS (
  SELECT nodes.*, coalesce(n, 0) AS n_children, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * length(k[depth].t) END AS saved
  FROM nodes LEFT JOIN children USING (depth, k)
), sums AS (
  SELECT d AS depth, k[1:d] AS k, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved
  FROM weighed, unnest(range(0, depth + 1)) AS u(d) GROUP BY d, k[1:d]
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM weighed n JOIN sums s USING (depth, k) LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.k = n.k[1:n.depth - 1]
"""


def queries() -> dict:
    return {"op1_ann": op1_ann, "op2_chat_format": op2_chat_format, "op3_sentencepiece": op3_sentencepiece, "op4_html_extract": op4_html_extract, "op5_packing": op5_packing, "op6_token_counts": op6_token_counts, "op7_quality": op7_quality, "op8_suffix_dedup": op8_suffix_dedup, "op9_jaccard_join": op9_jaccard_join, "op10_imatch": op10_imatch, "op11_periodic_runs": op11_periodic_runs, "op12_secrets": op12_secrets, "op13_prefix_trie": op13_prefix_trie}


def oracle_sql() -> dict:
    return {"op2_chat_format": OP2_SQL, "op13_prefix_trie": OP13_SQL}
