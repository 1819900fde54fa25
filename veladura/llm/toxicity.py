"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  Each sentence has a logistic score over its distinct
words, and the document's score is their noisy-or, 1 - prod(1 - p): one offending
sentence makes an offending document.  Only document labels are needed to learn: the
gradient of the noisy-or reaches the sentences that explain the label.  Afterwards the
sentence scores locate what offends.

A word's features are the word and its beginnings, as offending words come in many
forms.  Only features that toxic and clean documents hold at clearly different rates
(``LEAST_Z``) enter the model, so that ordinary words weigh nothing.  From a sentence's
score that of a sentence without any such word is taken off; otherwise the small scores
of thousands of ordinary sentences would add up in a long text.

The model is fitted on a bounded, documented sample (``SAMPLE`` labelled documents of
each class, none longer than ``SAMPLE_CHARS``; the first by a hash of their id), each
class weighted up to its full count.  Its size is bounded by ``VOCABULARY`` features.
Scoring is one pass over all whole texts, without any exchange.

Edge cases: a null or empty text has no sentences and scores 0; labels that contradict
each other for a document count as toxic; null labels and labels of unknown documents
are ignored; repeated rows are scored alike; with labels of one class only, or none, the
score of every document is the share of toxic labels (0 without labels); an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veladura.llm.common import free_name, map_batches, ship, with_text_value

ship(__name__)

SAMPLE, SAMPLE_CHARS, VOCABULARY, MIN_DOCS, LEAST_Z = 2500, 30_000, 20_000, 4, 4.2
STEPS, RATE, RIDGE = 300, 0.1, 2e-5
BEGINNINGS = range(3, 9)
#: Words whose weight a task remembers.
REMEMBERED = 300_000
OFFENDING = 0.5

_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?\n]+")


@dataclass(frozen=True)
class ToxicityModel:
    bias: float
    weights: dict[str, float]
    constant: float | None = None  # the score of everything, where nothing could be learned


def held_out(doc_id: Column) -> Column:
    """Rows that labels are never learned from: one in five, by a checksum of the id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sentences(text: str) -> list[tuple[int, int, list[str]]]:
    """Start, end and words of every sentence that has words."""
    out, start = [], 0
    for end, nxt in [*(m.span() for m in _SENTENCE.finditer(text)), (len(text), len(text))]:
        words = _WORD.findall(text[start:end].lower())
        if words:
            out.append((start, end, words))
        start = nxt
    return out


def features(word: str) -> list[str]:
    return [word, *(word[:n] + "-" for n in BEGINNINGS if n < len(word))]


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ToxicityModel:
    """Learn from the labels of documents that are not held out."""
    known = (
        labels.filter("toxic in (0, 1) and doc_id is not null")
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .filter(~held_out(F.col("doc_id")))
    )
    totals = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    n_bad, n_good = totals.get(1, 0), totals.get(0, 0)
    if not n_bad or not n_good:
        return ToxicityModel(0.0, {}, n_bad / max(n_bad + n_good, 1))
    order = F.xxhash64("doc_id")
    chosen = known.filter("toxic = 1").orderBy(order, "doc_id").limit(sample).unionByName(
        known.filter("toxic = 0").orderBy(order, "doc_id").limit(sample)
    )  # at most 2 * sample ids, so they may be broadcast
    texts = docs.select(F.col("doc_id").alias("id"), "text").filter(
        F.coalesce(F.length("text"), F.lit(0)).between(1, SAMPLE_CHARS)
    )
    rows = texts.join(F.broadcast(chosen), F.col("id") == F.col("doc_id")).groupBy("id").agg(
        F.max("text").alias("text"), F.max("toxic").alias("toxic")
    ).orderBy("id").collect()
    return _fit(
        [sentences(r["text"]) for r in rows], np.array([r["toxic"] for r in rows]), n_bad, n_good
    )


def _fit(bags: list[list[tuple]], toxic: np.ndarray, n_bad: int, n_good: int) -> ToxicityModel:
    if not (toxic == 1).any() or not (toxic == 0).any():
        return ToxicityModel(0.0, {}, n_bad / max(n_bad + n_good, 1))
    held: dict[str, list[int]] = {}
    for bag, t in zip(bags, toxic.tolist()):
        for f in {f for w in {w for _, _, ws in bag for w in ws} for f in features(w)}:
            held.setdefault(f, [0, 0])[t] += 1
    n_clean, n_toxic = int((toxic == 0).sum()), int((toxic == 1).sum())

    def z_score(counts: list[int]) -> float:
        clean, bad = counts
        rate = (clean + bad) / (n_clean + n_toxic)
        spread = math.sqrt(rate * (1 - rate) * (1 / n_clean + 1 / n_toxic))
        return abs(bad / n_toxic - clean / n_clean) / spread if spread else 0.0

    told = {f: z_score(c) for f, c in held.items() if sum(c) >= MIN_DOCS}
    useful = sorted((f for f, z in told.items() if z >= LEAST_Z), key=lambda f: (-told[f], f))
    number = {f: i for i, f in enumerate(useful[:VOCABULARY])}
    words, of_sentence, of_bag = [], [], []
    for b, bag in enumerate(bags):
        for _, _, ws in bag:
            got = [number[f] for w in set(ws) for f in features(w) if f in number]
            words += got
            of_sentence += [len(of_bag)] * len(got)
            of_bag.append(b)
    words, of_sentence, of_bag = (np.array(x, np.int64) for x in (words, of_sentence, of_bag))
    weight = np.where(toxic == 1, n_bad / (toxic == 1).sum(), n_good / (toxic == 0).sum())
    weight = weight / weight.sum()
    theta = np.zeros(len(number) + 1)
    theta[-1] = -6.0
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        z = np.bincount(of_sentence, theta[words], len(of_bag)) + theta[-1]
        z = np.clip(z, -30, 30)
        quiet = np.bincount(of_bag, np.logaddexp(0, z), len(bags))  # -log(1 - P)
        p_bag = -np.expm1(-quiet)
        p = 1 / (1 + np.exp(-z))
        # d loss / d z: p for clean documents, -p (1 - P) / P for toxic ones
        pull = np.where(toxic == 1, -(1 - p_bag) / np.maximum(p_bag, 1e-9), 1.0) * weight
        g_z = p * pull[of_bag]
        g = np.append(np.bincount(words, g_z[of_sentence], len(number)), g_z.sum())
        g[:-1] += RIDGE / 10 * theta[:-1]
        first = 0.9 * first + 0.1 * g
        second = 0.999 * second + 0.001 * g * g
        theta -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return ToxicityModel(float(theta[-1]), {f: float(theta[i]) for f, i in number.items()})


class Scorer:
    """A model with the weights of the words seen so far."""

    def __init__(self, model: ToxicityModel):
        self.model = model
        self.seen: dict[str, float] = {}
        self.leak = math.log1p(math.exp(model.bias))  # -log(1 - p) of a sentence without features

    def weight(self, word: str) -> float:
        got = self.seen.get(word)
        if got is None:
            get = self.model.weights.get
            got = sum([get(f, 0.0) for f in features(word)])
            if len(self.seen) < REMEMBERED:
                self.seen[word] = got
        return got

    def score(self, text: str | None) -> tuple[float, list[dict]]:
        """The document's score and its offending sentences (code points, end exclusive)."""
        if self.model.constant is not None:
            return self.model.constant, []
        quiet, found = 0.0, []
        for start, end, words in sentences(text or ""):
            own = sum([self.weight(w) for w in set(words)])
            if own <= 0:
                continue
            z = self.model.bias + own
            quiet += (math.log1p(math.exp(z)) if z < 30 else z) - self.leak
            if z >= 0:  # a sentence score of 0.5 or more
                found.append({"start": start, "end": end, "score": 1 / (1 + math.exp(-min(z, 700)))})
        return -math.expm1(-quiet), found


def score_documents(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``doc_id, score, predicted, offending`` of every whole text."""
    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    schema = (
        f"doc_id {kind}, score double, predicted int, "
        "offending array<struct<start:bigint,end:bigint,score:double>>"
    )

    def prepare():
        scorer = Scorer(model)

        def run(columns):
            scored = [scorer.score(t) for t in columns["text"]]
            return {
                "doc_id": columns["doc_id"],
                "score": [s for s, _ in scored],
                "predicted": [int(s >= 0.5) for s, _ in scored],
                "offending": [f for _, f in scored],
            }

        return run

    return map_batches(docs.select("doc_id", "text"), schema, prepare)


def drop_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The documents that score below 0.5, with the columns they had."""
    name = free_name(docs, "score")

    def prepare():
        scorer = Scorer(model)
        return lambda text: scorer.score(text)[0]

    scored = with_text_value(docs, name, "double", prepare)
    return scored.filter(F.col(name) < 0.5).select(*docs.columns)
