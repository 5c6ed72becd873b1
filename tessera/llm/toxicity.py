"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a probability from a logistic model over its
words; the document's score is the noisy-or of its sentences, 1 - prod(1 - p). Only documents carry labels: the
gradient of the document's likelihood runs through the noisy-or into the sentences, so the model also
locates the sentences that make a document toxic. A leak, left out of scores, takes up labels that no sentence explains.

Length alone must not add up, so one rule holds in training and in scores: a sentence without a telling word has probability 0, and of a document's
sentences below ``QUIET`` only the likeliest has one (they raise a score by ``QUIET`` at most, however many there are). The noisy-or is over the sentences that this leaves.

Training uses at most ``max_train`` labelled documents per label and ``max_bytes`` of their texts (documented bounds: those with the least hash of
their id), never their source, language or id as features. Scoring reads every whole text.

Sentences end at the full stops, question and exclamation marks of Latin, Chinese, Japanese, Arabic, Indic and other scripts and at line feeds. Words are runs of letters and
digits; scripts that do not part words (Han, kana, Thai, Lao, Khmer, Burmese) give pairs of neighbouring characters.

Defined results: null and empty texts have no sentence and get the score of an empty bag, 0; equal texts get
equal scores; repeated rows stay repeated; without a labelled row of both kinds every score is 0; labels
that conflict for an id count once each; of rows that repeat an id the least text trains; extra columns are not looked at.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import fold, marked, materialise, maybe_in, slices

MAX_TRAIN, MAX_BYTES = 12_000, 48 << 20
QUIET = 0.05
_END = ".!?\u3002\uff01\uff1f\uff61\u2026\u061f\u06d4\u0964\u0965\u1362\u104b"
SENTENCE = re.compile(rf"[^{_END}\n]+(?:[{_END}]+|\n|\Z)")
_TOKEN = re.compile(r"[^\W_]+")
_JOINED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_RUNS = re.compile(rf"[{_JOINED}]+|[^\W_{_JOINED}]+")
_FIRST = re.compile(f"[{_JOINED}]")


def sentences(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of each sentence: up to its closing marks or line feed."""
    return [m.span() for m in SENTENCE.finditer(text or "") if not m[0].isspace()]


def tokens(sentence: str) -> list[str]:
    """Words in lower case; pairs of neighbouring characters in scripts that do not part words."""
    said = sentence.lower()
    if said.isascii() or not _FIRST.search(said):
        return _TOKEN.findall(said)
    out = []
    for run in _RUNS.findall(said):
        if _FIRST.match(run):
            out += [run[i : i + 2] for i in range(max(1, len(run) - 1))]
        else:
            out.append(run)
    return out


def bags(texts: list[str], columns_of: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(columns, sentence number of each column, document number of each sentence); new words get new columns."""
    columns: list[int] = []
    lengths: list[int] = []
    owners: list[int] = []
    for i, text in enumerate(texts):
        for start, end in sentences(text):
            found = {columns_of.setdefault(w, len(columns_of)) for w in tokens(text[start:end])}
            columns.extend(sorted(found))
            lengths.append(len(found))
            owners.append(i)
    counts = np.asarray(lengths, np.int64)
    return np.asarray(columns, np.int64), np.repeat(np.arange(len(counts)), counts), np.asarray(owners, np.int64)


def telling(columns: np.ndarray, documents: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Which of n words go with a label beyond chance: a G test by documents, its bound raised for the number of words tried."""
    pairs = np.unique(columns * len(y) + documents)
    word, label = pairs // len(y), y[pairs % len(y)]
    a = np.bincount(word, label, minlength=n)
    b = np.bincount(word, 1 - label, minlength=n)
    share = y.sum() / len(y)
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (np.where(a > 0, a * np.log(a / ((a + b) * share)), 0) + np.where(b > 0, b * np.log(b / ((a + b) * (1 - share))), 0))
    return g > 2 * np.log(max(2, n)) + 6


def sentence_logits(weights: np.ndarray, bias: float, columns: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return bias + np.bincount(rows, weights[columns], minlength=n)


def noisy_or(p: np.ndarray, owners: np.ndarray, n: int) -> np.ndarray:
    return 0.0 - np.expm1(np.bincount(owners, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=n))


def speaking(p: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """The sentences' probabilities, 0 for those below QUIET but the likeliest of a document (the first of equals)."""
    quiet = np.flatnonzero(p < QUIET)
    order = quiet[np.lexsort((quiet, -p[quiet], owners[quiet]))]
    later = np.append(False, owners[order][1:] == owners[order][:-1])[: len(order)]
    out = p.copy()
    out[order[later]] = 0.0
    return out


def likelihood(theta: np.ndarray, columns: np.ndarray, rows: np.ndarray, owners: np.ndarray, y: np.ndarray, balance: np.ndarray) -> tuple[float, np.ndarray]:
    """The weighted log-likelihood of the documents' labels and its gradient; theta: weights, bias, leak; every sentence has a telling word."""
    weights, bias, leak = theta[:-2], theta[-2], theta[-1]
    n, m = len(owners), len(y)
    p = speaking(1 / (1 + np.exp(-sentence_logits(weights, bias, columns, rows, n))), owners)
    still = 1 / (1 + np.exp(-leak))
    q = np.clip(1 - (1 - noisy_or(p, owners, m)) * (1 - still), 1e-9, 1 - 1e-12)
    value = float((balance * np.where(y == 1, np.log(q), np.log1p(-q))).sum())
    # d log(1 - q) / d logit of one sentence is -p, as 1 - q is a product of 1 - p
    pull = balance * np.where(y == 1, (1 - q) / q, -1.0)
    slope = pull[owners] * p
    return value, np.append(np.bincount(columns, slope[rows], minlength=len(weights)), [slope.sum(), pull.sum() * still])


def fit(texts: list[str], labels: np.ndarray, epochs: int = 150, rate: float = 0.15, l2: float = 1e-5) -> tuple[dict[str, float], float]:
    """Word weights and bias by Adam on the whole-bag likelihood over the telling words, classes weighing alike; fixed start and order, so reruns agree."""
    vocabulary: dict[str, int] = {}
    columns, rows, owners = bags(texts, vocabulary)
    y = labels.astype(float)
    chosen = telling(columns, owners[rows], y, len(vocabulary))
    keep = chosen[columns]
    columns, rows = (np.cumsum(chosen) - 1)[columns[keep]], rows[keep]
    said, rows = np.unique(rows, return_inverse=True)  # sentences with a telling word
    owners = owners[said]
    balance = np.where(y == 1, 0.5 / max(1.0, y.sum()), 0.5 / max(1.0, (1 - y).sum()))
    theta = np.append(np.zeros(int(chosen.sum())), [-5.0, -3.0])
    moment, square = np.zeros(len(theta)), np.zeros(len(theta))
    for step in range(1, epochs + 1):
        grad = likelihood(theta, columns, rows, owners, y, balance)[1]
        grad[:-2] -= l2 * theta[:-2]
        moment = 0.9 * moment + 0.1 * grad
        square = 0.999 * square + 0.001 * grad**2
        theta = theta + rate * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    words = [w for w, i in vocabulary.items() if chosen[i]]
    return dict(zip(words, theta[:-2].tolist(), strict=True)), float(theta[-2])


def document_scores(p: np.ndarray, owners: np.ndarray, n: int) -> np.ndarray:
    """The noisy-or that training fits, without the leak."""
    return noisy_or(speaking(p, owners), owners, n)


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_bytes: int = MAX_BYTES, held_out_of: int = 5, label: str = "toxic") -> DataFrame:
    """(word, weight), the bias at word null, fitted in one task on the bounded sample."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter("y in (0, 1)").distinct()
    known = known.filter(F.crc32(F.col("doc_id").cast("string")) % held_out_of != 0)
    order = F.xxhash64("doc_id")
    few = known.filter("y = 1").orderBy(order, "doc_id").limit(max_train).unionByName(known.filter("y = 0").orderBy(order, "doc_id").limit(max_train))
    few = materialise(few, "toxicity-sample")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = maybe_in(texts, "doc_id", marked(few, "doc_id")).join(few, "doc_id").groupBy("y", "doc_id").agg(F.min("text").alias("text"))
    rows = materialise(rows, "toxicity-texts")
    # at most 2 x max_train sizes meet in the running sum, without their texts
    sofar = F.sum("n_bytes").over(W.partitionBy("y").orderBy(order, "doc_id").rowsBetween(W.unboundedPreceding, 0))
    fit_in = rows.select("y", "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n_bytes")).withColumn("sofar", sofar).filter(F.col("sofar") <= max_bytes // 2)
    rows = rows.join(fit_in.select("y", "doc_id"), ["y", "doc_id"], "left_semi").select("y", "text", "doc_id")

    def run(key, group):
        order = sorted(zip(group["doc_id"].to_pylist(), group["y"].to_pylist(), (x or "" for x in group["text"].to_pylist()), strict=True))
        y = np.asarray([x[1] for x in order])
        weights, bias = fit([x[2] for x in order], y) if 0 < y.sum() < len(y) else ({}, -math.inf)
        return pa.table({"word": pa.array([None, *weights], pa.string()), "weight": pa.array([bias, *weights.values()], pa.float64())})

    return rows.groupBy(F.lit(1).alias("_one")).applyInArrow(run, "word string, weight double")


SCORES = "doc_id long, score double, predicted int, n_sentences long, offending array<struct<start:int,end:int,score:double>>"


def score(docs: DataFrame, model: DataFrame) -> DataFrame:
    """Score of every row and the places of its offending sentences (those likelier toxic than not, else the worst of a toxic document)."""
    weights = {r.word: r.weight for r in model.collect()}  # telling words of the bounded sample: a few hundred as a rule
    bias = weights.pop(None, -math.inf)
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def logits(text: str, known: dict[str, float]) -> list[float]:
        out = []
        for start, end in sentences(text):
            found = known.keys() & tokens(text[start:end])
            out.append(bias + sum(sorted(known[w] for w in found)) if found else -math.inf)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for part in slices(batches):
            texts = [x or "" for x in part.column(1).to_pylist()]
            each = [logits(x, known) for x in texts]
            counts = np.asarray([len(x) for x in each], np.int64)
            p = np.exp(-np.logaddexp(0, -np.asarray([z for x in each for z in x], float)))
            q = document_scores(p, np.repeat(np.arange(len(texts)), counts), len(texts))
            ends = np.append(0, np.cumsum(counts))
            bad = []
            for i, text in enumerate(texts):
                own = p[ends[i] : ends[i + 1]]
                hits = np.flatnonzero(own >= 0.5) if q[i] >= 0.5 else ()
                if q[i] >= 0.5 and len(hits) == 0:
                    hits = [int(own.argmax())]
                spans = sentences(text) if len(hits) else ()
                bad.append([{"start": spans[k][0], "end": spans[k][1], "score": float(own[k])} for k in hits])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(q), pa.array((q >= 0.5).astype(np.int32)), pa.array(counts), pa.array(bad, kind)], ["doc_id", "score", "predicted", "n_sentences", "offending"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCORES)


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Trains on the labelled rows outside the held-out fold and scores all rows."""
    model = materialise(train(docs, labels, **options), "toxicity-model")
    return score(docs, model)


__all__ = ["fit", "fold", "likelihood", "score", "sentences", "toxicity", "train"]
