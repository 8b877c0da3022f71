"""Suffix dedup, the Jaccard join, components and fingerprints against brute force."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from apothecary.llm import fingerprints, jaccard, suffix_dedup
from apothecary.llm.components import connected_components
from tests.conftest import SMALL

EDGES = [(100, None), (101, ""), (102, "x" * 99), (103, "y" * 100), (104, "y" * 100), (105, "ab" * 300), (106, "é" * 120), (107, " "), (108, "one two"), (109, "one two")]


@pytest.fixture(scope="module")
def texts(spark):
    """Small documents, edge cases, exact and near copies and a shared passage."""
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()]
    docs = [(i, t) for i, t in docs if i < 100]
    rng, out = random.Random(5), docs + EDGES
    base, passage = docs[7][1].split()[:150], " ".join(docs[9][1].split()[:60])
    for n in range(40):
        words = list(base)
        for _ in range(n % 5):
            words[rng.randrange(len(words))] = f"w{rng.randrange(1000)}"
        out.append((200 + n, " ".join(words)))
        out.append((300 + n, f"{docs[n][1][:200]} {passage} tail{n}"))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({"key": F.lit(1), "kept": F.lit("x"), "class_id": F.lit(1)}).repartition(4)


def brute_repeats(rows, n=100):
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for at in range(len(data) - n + 1):
            s = data[at : at + n]
            if s in seen:
                gone[at : at + n] = b"\1" * n
            seen.add(s)
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out[i] = (len(data), sum(gone), sum(1 for k in range(len(data)) if gone[k] and (not k or not gone[k - 1])), hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup(spark, texts):
    got = suffix_dedup.remove_repeats(frame(spark, texts)).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == brute_repeats(texts)
    assert all(sum(b - a for a, b in zip(r["spans"][::2], r["spans"][1::2], strict=True)) == r["n_removed"] for r in got)


def test_suffix_dedup_of_repeated_rows_null_ids_and_nothing(spark):
    text = "".join(chr(97 + k * 7 % 26) for k in range(90)) + "unique tail of this one text"
    got = suffix_dedup.remove_repeats(frame(spark, [(5, text), (5, text), (6, text), (None, text)])).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["n_removed"]) for r in got] == [(None, 0), (5, len(text)), (5, len(text)), (6, len(text))]
    assert suffix_dedup.remove_repeats(frame(spark, [])).collect() == []


def brute_repeats_of_places(rows, n=100):
    """Rows of one id share one place: a string repeats one of a smaller id, or one earlier in its own text."""
    below, out = {}, {}
    order = lambda i: (i is not None, i or 0)
    for i in sorted({i for i, _ in rows}, key=order):
        found = set()
        for text in {t for j, t in rows if j == i}:
            data, seen = text.encode(), set()
            gone = bytearray(len(data))
            for at in range(len(data) - n + 1):
                s = data[at : at + n]
                if s in below or s in seen:
                    gone[at : at + n] = b"\1" * n
                seen.add(s)
            found |= seen
            out[i, len(data), hashlib.sha256(bytes(b for b, g in zip(data, gone, strict=True) if not g)).hexdigest()] = sum(gone)
        below.update(dict.fromkeys(found))
    return out


@pytest.mark.parametrize("shared_id", [7, None])
def test_suffix_dedup_of_a_thousand_rows_of_one_id(spark, shared_id):
    rng = random.Random(3)
    letters = lambda k: "".join(rng.choice("abcdefghij ") for _ in range(k))
    passage = letters(150)
    rows = [(1, letters(80) + passage + letters(200))] + [(shared_id, letters(rng.randrange(90, 160)) + passage * (k % 2) + letters(rng.randrange(90))) for k in range(1000)]
    rows += [(9, passage + letters(50) + passage[:120])]
    got = suffix_dedup.remove_repeats(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {(r["doc_id"], r["n_bytes"], r["kept_sha256"]): r["n_removed"] for r in got} == brute_repeats_of_places(rows)


def test_suffix_dedup_of_long_texts_part_by_part(spark, texts, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_LOAD", 333)
    rows = texts + [(900, "ab" * 1500), (901, "".join(t or "" for _, t in texts[:20])), (902, "".join(t or "" for _, t in texts[5:25]) * 2)]
    got = suffix_dedup.remove_repeats(frame(spark, rows)).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == brute_repeats(rows)


def shingles(text):
    w = (text or "").split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute_groups(rows):
    sets = {i: shingles(t) for i, t in rows}
    kinds = list({s for s in sets.values() if s})
    links = {s: [o for o in kinds if o != s and len(s & o) >= 0.8 * len(s | o) - 1e-12] for s in kinds}
    first = {s: min(i for i in sets if sets[i] == s) for s in kinds}
    root = dict(first)
    for _ in kinds:
        root = {s: min([root[s], *(root[o] for o in links[s])]) for s in kinds}
    return {i: (root[s], len(links[s]), sum(o == s for o in sets.values())) if s else (i, 0, 1) for i, s in sets.items()}


@pytest.mark.parametrize(("block", "most"), [(2048, 1 << 20), (7, 1 << 20), (2048, 600)])
def test_jaccard_groups(spark, texts, block, most):
    got = jaccard.jaccard_groups(frame(spark, texts), block=block, block_shingles=most).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"], r["n_copies"]) for r in got} == brute_groups(texts)


def test_jaccard_edges(spark):
    got = jaccard.jaccard_groups(frame(spark, [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (None, None)])).collect()
    assert sorted(((r["doc_id"] or 0), r["class_id"] or 0, r["n_copies"]) for r in got) == [(0, 0, 1), (0, 3, 3), (3, 3, 3), (3, 3, 3)]
    assert jaccard.jaccard_groups(frame(spark, [])).collect() == []


def test_a_long_chain_of_sets_is_compared_bucket_by_bucket(spark, monkeypatch):
    """Texts that slide along one another link far more texts than are alike."""
    words = [f"w{k}" for k in range(900)]
    rows = [(k, " ".join(words[k : k + 60])) for k in range(0, 800, 3)]
    chosen = []
    dealt = jaccard._dealt
    monkeypatch.setattr(jaccard, "_dealt", lambda *a: chosen.append(dealt(*a)) or chosen[-1])
    got = jaccard.jaccard_groups(frame(spark, rows), block=2).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"], r["n_copies"]) for r in got} == brute_groups(rows)
    assert chosen[0].where("band >= 0").count() > 0


def test_shingles_of_long_texts_go_block_by_block(monkeypatch):
    words = [f"w{k * k % 977}é" for k in range(3000)] + ["x" * 5000, "y"] + ["z"] * 9
    whole = jaccard.word_hashes(words)
    monkeypatch.setattr(jaccard, "_BLOCK", 700)
    assert (jaccard.word_hashes(words) == whole).all() and len(whole) == len(words)
    assert len(set(whole.tolist())) == len(set(words))


def test_pruning_keeps_pairs_at_the_threshold():
    least = jaccard.least_matches(0.8, 1e-8)
    assert all(m < 0.75 * n for n, m in least.items()) and max(least) == jaccard.ROWS * jaccard.BANDS


def test_components_of_a_chain_a_star_and_loops(spark):
    edges = [(k, k + 1) for k in range(1, 60)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7), (None, 3), (500, 400)]
    got = dict(tuple(r) for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {k: 1 for k in range(1, 61)} | {100 + k: 100 for k in range(30)} | {400: 400, 500: 400}
    assert connected_components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_fingerprints(spark, texts):
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_documents(frame(spark, texts)).collect()}
    rows, counts = sorted((i, t or "") for i, t in texts), Counter()
    for _, t in rows:
        counts.update(fingerprints.terms(t))
    n = len(rows)
    prints = fingerprints.Fingerprinter(sorted(t for t, k in counts.items() if max(2, n / 1500) <= k <= max(2, n / 50)))
    for k, (i, t) in enumerate(rows):
        after, cut = rows[(k + 1) % n][1], len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        r = got[i]
        assert (r["edited"], r["n_chars"], r["fingerprint"], r["edited_fingerprint"]) == (edited, len(t), prints(t), prints(edited))
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["near_next"] == fingerprints.likeness(prints(t), prints(after)) and 0 <= r["near_edited"] <= 1


def test_edited_texts_are_nearer_than_the_next(spark):
    got = fingerprints.fingerprint_documents(spark.read.parquet(f"{SMALL}/documents.parquet")).where("n_chars > 300").collect()
    assert sum(r["near_edited"] > r["near_next"] for r in got) > 0.9 * len(got)


def test_fingerprints_of_one_repeated_or_no_document(spark):
    one = fingerprints.fingerprint_documents(frame(spark, [(1, "abcdefgh")])).collect()
    assert [(r["edited"], r["near_next"]) for r in one] == [("abcdefab", 1.0)]
    both = fingerprints.fingerprint_documents(frame(spark, [(1, "aa bb"), (1, "aa bb"), (None, None)])).collect()
    assert sorted((r["n_chars"], r["near_next"]) for r in both)[0][0] == 0 and len(both) == 3
    assert fingerprints.fingerprint_documents(frame(spark, [])).collect() == []
