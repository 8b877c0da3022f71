"""A quality classifier learnt from trusted positives and unlabelled text.

Positive-unlabelled learning: with the class prior p, the risk of a scorer is
p R_P(+) + max(0, R_U(-) - p R_P(-)), where the second part estimates the
risk on negatives without seeing any and is kept from going below zero. The
prior is estimated from a first classifier of positives against unlabelled
text. The scorer is a small network on the text alone: figures of its surface
and the shares of hashed byte trigrams and hashed words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apothecary.llm.common import chosen, slices
from apothecary.llm.jaccard import text_hashes

_SYMBOLS = np.array([33 <= b < 127 and not chr(b).isalnum() and chr(b) not in ".,;:'\"!?()-|" for b in range(256)], dtype=float)
_UPPER = np.array([65 <= b < 91 for b in range(256)], dtype=float)
_LETTER = np.array([65 <= b < 91 or 97 <= b < 123 for b in range(256)], dtype=float)
_DIGIT = np.array([48 <= b < 58 for b in range(256)], dtype=float)
_ONE = {c: np.eye(1, 256, ord(c))[0] for c in "!|\n.,"}


_HASHED = 256  # buckets of trigrams, and as many of words


_BLOCK = 1 << 18  # bytes of a text counted at a time


def _trigrams(data: np.ndarray) -> np.ndarray:
    """The shares of byte trigrams in each bucket."""
    out = np.zeros(_HASHED)
    for at in range(0, len(data) - 2, _BLOCK):
        wide = data[at : at + _BLOCK + 2].astype(np.uint32)
        codes = (wide[:-2] << np.uint32(16) | wide[1:-1] << np.uint32(8) | wide[2:]) * np.uint32(2_654_435_761)
        out += np.bincount(codes >> np.uint32(24), minlength=_HASHED)
    return out / max(1, len(data) - 2)


def features(texts: list[str]) -> np.ndarray:
    """A row of figures for each text; zeros for an empty one. Words are told apart by 64-bit hashes."""
    hashed = np.zeros((len(texts), 2 * _HASHED))
    histogram, others = np.zeros((len(texts), 256)), np.zeros((len(texts), 6))
    for k, text in enumerate(texts):
        coded = text.encode()
        if not coded:
            continue
        data, words = np.frombuffer(coded, dtype=np.uint8), text_hashes(text)
        n = max(1, len(words))
        hashed[k, :_HASHED] = _trigrams(data)
        hashed[k, _HASHED:] = np.bincount((words >> np.uint64(56)).astype(np.int64), minlength=_HASHED) / n
        for at in range(0, len(data), _BLOCK):
            histogram[k] += np.bincount(data[at : at + _BLOCK], minlength=256)
        others[k] = (
            np.log1p(len(data)),
            len(zlib.compress(coded, 1)) / (len(data) + 20),
            (words[1:] == words[:-1]).sum() / n,
            len(np.unique(words)) / n,
            len(data) / n,
            n,
        )
    size = np.maximum(1, histogram.sum(axis=1))
    n = np.maximum(1, others[:, 5])
    counts = histogram @ np.stack([_SYMBOLS, _UPPER, _LETTER, _DIGIT, *_ONE.values()], axis=1)
    shares = [counts[:, 0] / size, counts[:, 1] / np.maximum(1, counts[:, 2]), counts[:, 3] / size, *(counts[:, 4 + k] / n for k in range(5))]
    return np.column_stack([others[:, 0], others[:, 1], others[:, 2], others[:, 3], np.minimum(50, others[:, 4]), *(np.log1p(20 * s) for s in shares), hashed])


def _ratios(positive: np.ndarray, unlabelled: np.ndarray) -> np.ndarray:
    """Log ratios of the mean shares of each bucket in the two sets: a column for trigrams, one for words."""
    p, u = (x[:, -2 * _HASHED :].mean(axis=0) + 1e-5 for x in (positive, unlabelled))
    out = np.zeros((2 * _HASHED, 2))
    out[:_HASHED, 0], out[_HASHED:, 1] = np.log(p / u)[:_HASHED], np.log(p / u)[_HASHED:]
    return out


@dataclass
class Scorer:
    """A network with one hidden layer; scores are between 0 and 1, higher for better texts.

    Its inputs are the figures of ``features`` with the hashed shares summed
    up by ``ratios``, if there are any.
    """

    ratios: np.ndarray | None
    mean: np.ndarray
    spread: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return x if self.ratios is None else np.column_stack([x[:, : -2 * _HASHED], x[:, -2 * _HASHED :] @ self.ratios])

    def margin(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh(np.clip((self.inputs(x) - self.mean) / self.spread, -6, 6) @ self.w1 + self.b1)
        return hidden @ self.w2 + self.b2

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, hidden: int = 16, rounds: int = 3000, batch: int = 512, seed: int = 3) -> Scorer:
    """Minimises the non-negative risk with logistic loss by Adam on batches.

    ``prior`` 0.5 with equal batches is the plain classifier of one set
    against the other only if the guard is off; ``estimate_prior`` uses that.
    """
    return _fit(positive, unlabelled, prior, hidden, rounds, batch, seed, guarded=True)


def _fit(positive, unlabelled, prior, hidden, rounds, batch, seed, guarded) -> Scorer:
    rng = np.random.default_rng(seed)
    ratios = _ratios(positive, unlabelled) if positive.shape[1] > 2 * _HASHED else None
    scorer = Scorer(ratios, *[np.empty(0)] * 5, 0.0, prior)
    positive, unlabelled = scorer.inputs(positive), scorer.inputs(unlabelled)
    both = np.vstack([positive, unlabelled])
    d = both.shape[1]
    scorer = Scorer(ratios, both.mean(axis=0), both.std(axis=0) + 1e-6, rng.normal(0, d**-0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), 0.0, prior)
    p, u = (np.clip((x - scorer.mean) / scorer.spread, -6, 6) for x in (positive, unlabelled))
    params = [scorer.w1, scorer.b1, scorer.w2, np.zeros(1)]
    moment, square = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params]
    for step in range(1, rounds + 1):
        xp, xu = p[rng.integers(0, len(p), batch)], u[rng.integers(0, len(u), batch)]
        x = np.vstack([xp, xu])
        h = np.tanh(x @ params[0] + params[1])
        z = h @ params[2] + params[3]
        s = _sigmoid(z)
        if guarded:
            negative = np.logaddexp(0, z[batch:]).mean() - prior * np.logaddexp(0, z[:batch]).mean()
            slope_p, slope_u = prior * (s[:batch] - 1) / batch, np.zeros(batch)
            if negative >= 0:
                slope_p, slope_u = slope_p - prior * s[:batch] / batch, s[batch:] / batch
            else:  # the estimate fell below zero: step back from overfitting
                slope_p, slope_u = prior * s[:batch] / batch, -s[batch:] / batch
        else:
            slope_p, slope_u = (s[:batch] - 1) / batch, s[batch:] / batch
        slope = np.r_[slope_p, slope_u]
        inner = (slope[:, None] * params[2]) * (1 - h**2)
        rate = 0.02 * (1 - step / (rounds + 1))
        for k, g in enumerate((x.T @ inner + 1e-5 * params[0], inner.sum(axis=0), h.T @ slope + 1e-5 * params[2], np.array([slope.sum()]))):
            moment[k] = 0.9 * moment[k] + 0.1 * g
            square[k] = 0.999 * square[k] + 0.001 * g * g
            params[k] -= rate * (moment[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
    scorer.w1, scorer.b1, scorer.w2, scorer.b2 = params[0], params[1], params[2], float(params[3][0])
    return scorer


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 3) -> float:
    """The share of positives in ``unlabelled``: the least ratio of the two sets' shares above a threshold.

    Fewer than two rows in a set give 0.5.

    Thresholds come from a plain classifier fitted on one half of each set;
    the ratio is taken on the other half, where half of the positives or more
    pass. Both halves take turns, and the two figures are averaged.
    """
    if min(len(positive), len(unlabelled)) < 2:
        return 0.5
    found = []
    for turn in (0, 1):
        first = _fit(positive[turn::2], unlabelled[turn::2], 0.5, 16, 800, 512, seed, guarded=False)
        p, u = np.sort(first.margin(positive[1 - turn :: 2])), np.sort(first.margin(unlabelled[1 - turn :: 2]))
        at = np.quantile(p, np.linspace(0.002, 0.5, 100))
        above_p, above_u = (1 - np.searchsorted(x, at, side="left") / len(x) for x in (p, u))
        found.append((above_u / np.maximum(above_p, 1e-9)).min())
    return float(np.clip(np.mean(found), 0.05, 0.98))


def train(docs: DataFrame, labels: DataFrame, most: int = 5000, id_col: str = "doc_id", text_col: str = "text") -> Scorer | None:
    """A scorer from at most ``most`` trusted positives and about as many unlabelled texts (documented bounds).

    Only rows outside the held-out third take part, and of their labels only
    that ``quality`` is 1: rows labelled otherwise, or null, are unlabelled
    text like all others, and a label given twice counts once. The prior is
    estimated from those two sets alone and taken a little low, by 2 % and by
    more for few rows: the risk stays sound then, while too high a prior makes the guard hold everything for
    positive. None where either set is empty.
    """
    docs = chosen(docs, doc_id=id_col, text=text_col).where(~held_out("doc_id"))
    drawn = F.xxhash64(F.col("doc_id").cast("long"), F.lit(11))
    trusted = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).where(~held_out("doc_id")).distinct()
    trusted = trusted.orderBy(drawn, "doc_id").limit(most)
    share = min(1.0, most / max(1, docs.count()))
    other = docs.where(F.pmod(F.xxhash64(F.col("doc_id").cast("long"), "text", F.lit(11)), F.lit(1 << 30)) < int(share * (1 << 30)))

    def figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x = features([t or "" for t in part.column(0).to_pylist()]).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float32()))], names=["x"])

    positive = docs.join(F.broadcast(trusted), "doc_id", "left_semi").select("text").mapInArrow(figures, "x array<float>")
    unlabelled = other.select("text").mapInArrow(figures, "x array<float>")
    p, u = (np.array([r.x for r in df.limit(2 * most).collect()]) for df in (positive, unlabelled))
    if not len(p) or not len(u):
        return None
    return fit(p, u, estimate_prior(p, u) * (0.98 - 0.3 / max(1, min(len(p), len(u)) / 2) ** 0.5))


def held_out(column: str):
    """Whether a row is in the third that nothing is learnt from."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def score_column(scorer: Scorer | None, text: Column) -> Column:
    """The score of a text, 0 to 1; null texts count as empty, and without a scorer all texts get 1."""
    if scorer is None:
        return F.lit(1.0)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([texts], names=["text"])
        out = [scorer(features([t or "" for t in part.column(0).to_pylist()])) for part in slices(batch, "text")]
        return pa.array(np.concatenate(out) if out else np.empty(0))

    return scored(text)


def score(docs: DataFrame, scorer: Scorer | None, text_col: str = "text") -> DataFrame:
    """``docs`` with score and predicted (1 from a score of 0.5); columns of these names are replaced."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("score", "predicted")]
    scored = docs.select(*rest, score_column(scorer, F.col(f"`{text_col}`")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def score_documents(docs: DataFrame, labels: DataFrame, most: int = 5000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row of ``docs``: doc_id, held_out, score, predicted.

    Null texts are scored as empty ones; a null id is not held out; repeated
    rows stay; an empty table gives an empty result. Labels, language, source
    and id are no inputs of a score.
    """
    scorer = train(docs, labels, most, id_col, text_col)
    rows = chosen(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return score(rows, scorer).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
