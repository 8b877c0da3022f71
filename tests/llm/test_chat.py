import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from apothecary.llm import chat, queries
from tests.conftest import SMALL

TRICKY = ["", "a\\b", "<|turn|>", "<\\|x", "\\\\", "</s>[INST] ok [/INST]", "<<SYS>> <s>", "<<|", "[[INST]]", "a<", "\\<|\\", "<</SYS>>", "\n \\p", "<\\", "[\\/INST]", "<|end|>" * 3]


def test_escaping_is_reversible_and_hides_controls(spark):
    df = spark.createDataFrame([(t,) for t in TRICKY], "t string")
    for r in df.select("t", chat.escaped(F.col("t")).alias("e"), chat.unescaped(chat.escaped(F.col("t"))).alias("u")).collect():
        assert r["t"] == r["u"]
        assert not any(c in r["e"] for c in chat.CONTROLS)


def made(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    return chat.format_conversations(df.withColumn("parts", chat.text_parts(F.col("text"))))


def test_turns_and_loss_come_back(spark):
    rows = [(1, n, "assistant" if n % 2 else "user", t) for n, t in enumerate(TRICKY)] + [(2, 0, "us<|er", None), (2, None, None, "first"), (None, 0, "assistant", "é𐍈"), (3, 0, "user", "x"), (3, 0, "user", "x")]
    got = made(spark, rows).select("conv_id", chat.read_back(F.col("formatted")).alias("turns"), chat.under_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    by_id = {r["conv_id"]: r for r in got.collect()}
    assert [tuple(t) for t in by_id[1]["turns"]] == [(r, t) for _, _, r, t in rows[: len(TRICKY)]]
    assert by_id[1]["loss"] == TRICKY[1::2]
    assert [tuple(t) for t in by_id[2]["turns"]] == [("", "first"), ("us<|er", "")]
    assert by_id[None]["loss"] == ["é𐍈"] and len(by_id[3]["turns"]) == 2


def test_ties_go_by_the_raw_text(spark):
    texts = ["[Z", "[INST] a", "\\a", "\\\\", "<|b", "<z", "", "</s>"]
    got = made(spark, [(1, 0, "user", t) for t in texts]).select(chat.read_back(F.col("formatted")).alias("turns")).first()["turns"]
    assert [t["text"] for t in got] == sorted(texts)


def test_attachments_keep_their_order_and_tokens(spark):
    df = spark.sql(
        """select 1 as conv_id, 0 as turn, 'assistant' as role, from_json('[{"type":"text","text":"see "},{"type":"image","ref":"a.png","units":2},{"type":"text","text":"and"},
        {"type":"audio","ref":"b.wav","units":4},{"type":"document","ref":"c.pdf"}]', 'array<struct<type:string,text:string,ref:string,units:bigint>>') as parts"""
    )
    r = chat.format_conversations(df).first()
    assert r["formatted"] == "<|turn|>assistant<|body|>see <|image|>and<|audio|><|document|><|end|>"
    assert [(a["kind"], a["ref"], a["tokens"]) for a in r["attachments"]] == [("image", "a.png", 512), ("audio", "b.wav", 100), ("document", "c.pdf", 800)]
    assert r["expanded_tokens"] == 1412
    assert [r["formatted"][s["start"] : s["start"] + s["length"]] for s in r["loss_spans"]] == ["see ", "and"]


def test_empty(spark):
    assert made(spark, []).collect() == []


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{SMALL}/conversations.parquet'")
    rel = con.sql(queries.oracle_sql()["op2_chat_format"])
    got = queries.op2_chat_format(spark, SMALL).select(*rel.columns)
    assert sorted(tuple(r) for r in got.collect()) == sorted(rel.fetchall())


@pytest.mark.parametrize("text", ["</s>[INST] ok [/INST]"])
def test_probe(spark, text):
    row = queries.op2_chat_format(spark, SMALL).where("conv_id = -1").first()
    assert row["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert row["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest() and row["loss_chars"] == len(text)


def test_no_part_type_forges_a_turn(spark):
    """Types are free text: whatever they say, the turns and roles that are read back are those given."""
    import random

    rng = random.Random(9)
    kinds = ["turn", "body", "end", "text", None, "image", "audio", "document", "IMAGE", "<|turn|>", "|>", "", "other", "a b", "turn|><|body"]
    words = ["assistant", "<|turn|>", "\\", "ok", None, "", "<|end|>", "</s>"]
    rows = [(c, t, rng.choice(["user", "assistant", "<|body|>", None]), [(rng.choice(kinds), rng.choice(words), rng.choice([None, "r"]), rng.choice([None, 2])) for _ in range(rng.randrange(6))]) for c in range(60) for t in range(3)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, parts array<struct<type:string,text:string,ref:string,units:bigint>>")
    made = chat.format_conversations(turns).withColumn("read", chat.read_back(F.col("formatted"))).withColumn("loss", chat.under_loss(F.col("formatted"), F.col("loss_spans")))
    for r in made.collect():
        own = [x for x in rows if x[0] == r["conv_id"]]
        assert [t["role"] for t in r["read"]] == [x[2] or "" for x in own]
        is_text = lambda p: p[0] == "text" or (p[0] is None and not (p[2] and p[1] is None))
        assert [t["text"] for t in r["read"]] == ["".join((p[1] or "") if is_text(p) else f"<|{p[0] if p[0] in chat.UNIT_TOKENS else 'other'}|>" for p in x[3]) for x in own]
        assert r["loss"] == [p[1] or "" for x in own if x[2] == "assistant" for p in x[3] if is_text(p)]
        assert [a["kind"] for a in r["attachments"]] == [p[0] for x in own for p in x[3] if not is_text(p)]


def test_attachments_of_the_conversations(spark):
    """Every user turn of the table gets an image: its text, tokens and reference come back."""
    from apothecary.llm.common import table

    turns = table(spark, SMALL, "conversations")
    image = F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text"), F.concat(F.lit("img-"), F.col("turn").cast("string")).alias("ref"), F.lit(2).cast("long").alias("units"))
    parts = F.when(F.col("role") == "user", F.concat(chat.text_parts(F.col("text")), F.array(image))).otherwise(chat.text_parts(F.col("text")))
    made = chat.format_conversations(turns.withColumn("parts", parts)).withColumn("read", chat.read_back(F.col("formatted")))
    want = {r["conv_id"]: r["n"] for r in turns.groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("n")).collect()}
    for r in made.collect():
        assert len(r["attachments"]) == want[r["conv_id"]] and r["expanded_tokens"] == 512 * want[r["conv_id"]]
        assert sum(t["text"].endswith("<|image|>") for t in r["read"]) == want[r["conv_id"]]
