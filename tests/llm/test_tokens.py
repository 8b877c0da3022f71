import zlib

import numpy as np
import pytest
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from apothecary.llm import packing, sentencepieces, token_counts
from apothecary.llm.pretokens import ByteBpe, units
from tests.conftest import SMALL

JSON, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "a", "  a", "a  b ", "\n", " \n a\t b", "a <|endoftext|> b<|endoftext|>", "x" * 5000, "it's we'll 12345 $$$ ,,", "é b   c", "漢字 𐍈\r\n\x1c x", "a \u0085 b", "end ", "line\nbreak\n\nx"]


@pytest.fixture(scope="module")
def texts(spark):
    return ODD + [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]


def test_units_restore_the_text(texts):
    assert all(" ".join(units(t)) == t for t in texts)


def test_ids_are_the_librarys(texts):
    library, bpe = Tokenizer.from_file(JSON), ByteBpe(JSON, packing.BYTE_LEVEL)
    for t in texts:
        assert np.frombuffer(bpe.encoded(t), dtype="<u4").tolist() == library.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("path", [JSON, MODEL])
@pytest.mark.parametrize("head", [0, 50, 10**6])
def test_counts(spark, texts, path, head):
    rows = [(n, t) for n, t in enumerate(texts)] + [(None, None), (1, texts[1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("clash")).repartition(3)
    got = token_counts.count_tokens(df, path, head=head).collect()
    if path == JSON:
        library = Tokenizer.from_file(path)
        count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    else:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(model.encode(t))
    want = sorted((-1 if i is None else i, len((t or "").encode()), count(t or ""), count(t or "") > 512) for i, t in rows)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == want


def test_counts_of_nothing(spark):
    assert token_counts.count_tokens(spark.createDataFrame([], "doc_id long, text string"), JSON).collect() == []


def test_packing_holds_every_id_once(spark, texts):
    rows = [(n, t) for n, t in enumerate(texts)] + [(500, None), (500, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("offset", F.lit("clash"))
    got = [r.asDict() for r in packing.pack(packing.token_pieces(df, JSON, size=256), size=256).collect()]
    library = Tokenizer.from_file(JSON)
    for n, t in enumerate(texts):
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 1], dtype="<u4")
        mine, at = sorted((r for r in got if r["doc_id"] == n), key=lambda r: r["start"]), 0
        for r in mine:
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids[at : at + r["length"]].tobytes()))
            at += r["length"]
        assert at == len(ids)
    by_sequence = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert by_sequence.setdefault(r["sequence_id"], 0) == r["offset"]
        by_sequence[r["sequence_id"]] += r["length"]
    assert max(by_sequence.values()) <= 256 and sorted(by_sequence) == list(range(len(by_sequence)))
    assert sum(by_sequence.values()) > 0.95 * 256 * len(by_sequence)


def test_packing_nothing(spark):
    assert packing.pack(packing.token_pieces(spark.createDataFrame([], "doc_id long, text string"), JSON)).collect() == []


def test_patterns_use_demand_up_and_come_close_to_the_bound():
    sizes, demand = np.array([3, 5, 7, 11]), np.array([40, 10, 33, 12])
    patterns = packing.cutting_patterns(sizes, demand, 16)
    assert (sum(p * n for p, n in patterns) == demand).all() and all(p @ sizes <= 16 for p, _ in patterns)
    assert sum(n for _, n in patterns) <= np.ceil(sizes @ demand / 16) + 2


def best_score(word, score):
    best = [0.0] + [-np.inf] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(max(0, end - 16), end):
            best[end] = max(best[end], best[start] + score(word[start:end]))
    return best[-1]


def test_viterbi_against_brute_force(texts):
    library, model = sentencepiece.SentencePieceProcessor(model_file=MODEL), sentencepieces.UnigramModel(MODEL)
    pieces = {library.id_to_piece(i): library.get_score(i) for i in range(259, library.get_piece_size())}
    words = sorted({w for t in texts for w in t.split()})[:1500]
    for word, ids in zip(words, model.encode(words), strict=True):
        ids = ids.tolist()
        if any(3 <= i < 259 for i in ids):
            continue
        assert sum(library.get_score(i) for i in ids) == best_score("▁" + word, lambda p: pieces.get(p, -np.inf))


def test_encoding_round_trip(spark, texts):
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)] + [(None, None)], "doc_id long, text string").withColumn("ids", F.lit(0))
    encoded = sentencepieces.encode(df, MODEL)
    back = sentencepieces.decode(encoded, MODEL)
    assert {r["doc_id"]: r["text"] for r in back.collect()} == dict(enumerate(texts)) | {None: ""}
    assert encoded.where("text = '' or text is null").agg(F.max(F.size("ids"))).first()[0] == 0
    assert sentencepieces.encode(df.limit(0), MODEL).collect() == []


def _varint(data, at):
    value = shift = 0
    while True:
        byte = data[at]
        value, shift, at = value | (byte & 127) << shift, shift + 7, at + 1
        if byte < 128:
            return value, at


def _fields(data, at, end):
    """(number, begin, end) of the varint and length-delimited fields of a protobuf message."""
    while at < end:
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 2:
            size, at = _varint(data, at)
            yield key >> 3, at, at + size
            at += size
        elif kind == 0:
            begin = at
            _, at = _varint(data, at)
            yield key >> 3, begin, at
        else:
            at += 4 if kind == 5 else 8


def test_words_have_the_librarys_ids_under_a_unigram_reading_of_the_file(tmp_path):
    """The file's pieces and scores, read by the library itself as a unigram model: nearly all words agree, and none scores less here."""
    import duckdb
    import sentencepiece

    from apothecary.llm.common import public_tokenizer
    from apothecary.llm.sentencepieces import UnigramModel

    data = bytearray(open(public_tokenizer("piece_bpe_32k.model"), "rb").read())
    for number, begin, end in list(_fields(data, 0, len(data))):
        if number == 2:  # the trainer's settings, of which field 3 is the model's type
            data[next(b for n, b, _ in _fields(data, begin, end) if n == 3)] = 1
    (tmp_path / "unigram.model").write_bytes(data)
    library, own = sentencepiece.SentencePieceProcessor(model_file=f"{tmp_path}/unigram.model"), UnigramModel(f"{tmp_path}/unigram.model")
    texts = duckdb.sql(f"select text from '{SMALL}/documents.parquet'").fetchall()
    words = sorted({w for (t,) in texts for w in t.split()})
    total = lambda ids: sum(library.get_score(int(i)) for i in ids)
    different = [(w, x, y) for w, x, y in zip(words, own.encode(words), library.encode(words), strict=True) if list(x) != y]
    assert len(different) < 0.01 * len(words)
    assert all(total(x) >= total(y) - 1e-3 for _, x, y in different)


def test_a_file_that_normalises_texts_is_refused(monkeypatch):
    import sentencepiece

    from apothecary.llm.common import public_tokenizer
    from apothecary.llm.sentencepieces import UnigramModel

    monkeypatch.setattr(sentencepiece.SentencePieceProcessor, "normalize", lambda self, text: text.lower())
    with pytest.raises(ValueError, match="normalises"):
        UnigramModel(public_tokenizer("piece_bpe_32k.model"))
