"""Quality classifier by positive-unlabelled learning with the non-negative unbiased risk."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from parley.llm.common import fold, text_of
from parley.llm.registry import query, table

#: Bounds of the rows that a fit looks at, each kind in expectation.
POSITIVES, UNLABELLED = 3_000, 6_000

_SENTENCE_END = re.compile(rb"[.!?\n]+")


def _byte_classes() -> np.ndarray:
    """Bytes in 12 classes: other control, blank, line feed, digit, lower, upper, four kinds of marks, non-ASCII lead and tail."""
    kind = np.zeros(256, np.uint8)
    for k, chars in enumerate([b" \t\x0b\x0c\r", b"\n", b"0123456789", bytes(range(97, 123)), bytes(range(65, 91)),
                               b".,;:'\"-()", b"!?", b"#$%&*@^~+=", b"|<>[]{}/\\_`"], 1):
        kind[list(chars)] = k
    kind[128:192] = 10
    kind[192:] = 11
    return kind


KINDS = _byte_classes()
N_KINDS = 12
N_FEATURES = N_KINDS + N_KINDS * N_KINDS + 10


def features(text: str) -> np.ndarray:
    """Numbers of a whole text: shares of byte classes and of their pairs, repetition, lengths, compressibility."""
    data = text.encode("utf-8", "replace")
    out = np.zeros(N_FEATURES, np.float32)
    if not data:
        return out
    kinds = KINDS[np.frombuffer(data, np.uint8)]
    out[:N_KINDS] = np.bincount(kinds, minlength=N_KINDS) / len(kinds)
    if len(kinds) > 1:
        pairs = kinds[:-1].astype(np.int64) * N_KINDS + kinds[1:]
        out[N_KINDS: N_KINDS + N_KINDS * N_KINDS] = np.bincount(pairs, minlength=N_KINDS * N_KINDS) / len(pairs)
    words = data.split()
    lines = [x for x in data.split(b"\n") if x]
    n = max(1, len(words))
    size = np.fromiter(map(len, words), np.float32, len(words)) if words else np.zeros(1, np.float32)
    same = sum(map(bytes.__eq__, words[:-1], words[1:]))
    out[-10:] = (
        np.log1p(len(data)) / 10, np.log1p(len(words)) / 10, len(set(words)) / n, same / n,
        size.mean() / 10, size.std() / 10, len(set(lines)) / max(1, len(lines)), len(lines) / n,
        len(_SENTENCE_END.findall(data)) / n, len(zlib.compress(data, 1)) / len(data))
    return out


class PuModel(NamedTuple):
    """A scaled network with one hidden layer; ``prior`` is the class prior that it was fitted with."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ self.w1 + self.b1)
        return 1 / (1 + np.exp(-np.clip(hidden @ self.w2 + self.b2, -30, 30)))


def fit_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, hidden: int = 16, steps: int = 400,
           rate: float = 0.01, decay: float = 1e-3, seed: int = 7) -> PuModel:
    """Minimise prior * R+(positive) + max(0, R-(unlabelled) - prior * R-(positive)) of the logistic loss.

    Where the estimated risk of the negatives falls below zero, the fit has begun to memorise the
    positives, and the step goes the other way on that part alone. No positives give a model
    that scores the prior everywhere.
    """
    x = np.concatenate([positive, unlabelled]).astype(np.float64)
    if not len(positive) or not len(unlabelled):
        d = x.shape[1]
        odds = np.log(prior / (1 - prior))
        return PuModel(np.zeros(d), np.ones(d), np.zeros((d, 1)), np.zeros(1), np.zeros(1), odds, prior)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    x = np.clip((x - mean) / scale, -8, 8)
    n_p, n_u = len(positive), len(unlabelled)
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden),
              rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        h = np.tanh(x @ params[0] + params[1])
        z = h @ params[2] + params[3][0]
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        loss_neg = np.logaddexp(0, z)
        negative_risk = loss_neg[n_p:].mean() - prior * loss_neg[:n_p].mean()
        grad = np.zeros(len(x))
        if negative_risk >= 0:
            grad[:n_p] = prior * (p[:n_p] - 1) / n_p - prior * p[:n_p] / n_p
            grad[n_p:] = p[n_p:] / n_u
        else:
            grad[:n_p] = prior * p[:n_p] / n_p
            grad[n_p:] = -p[n_p:] / n_u
        back = np.outer(grad, params[2]) * (1 - h * h)
        grads = [x.T @ back + decay * params[0], back.sum(0), h.T @ grad + decay * params[2], np.array([grad.sum()])]
        for q, g, m, v in zip(params, grads, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            q -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return PuModel(mean, scale, params[0], params[1], params[2], float(params[3][0]), prior)


def _feature_rows(texts: DataFrame) -> list[tuple[bool, np.ndarray]]:
    """(positive, features) of rows (text, positive), computed where the rows are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [features(t).tobytes() for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(rows, pa.binary())], ["positive", "x"])

    return [(r.positive, np.frombuffer(r.x, np.float32)) for r in texts.mapInArrow(run, "positive boolean, x binary").collect()]


def train(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> PuModel:
    """Fit on a bounded sample of the rows where ``learn`` holds.

    Trusted positives are rows with label 1; unlabelled are rows of ``docs`` whatever their label.
    The class prior is the share of label 1 among the labelled rows that may be learned from;
    beyond that, label 0 is not used. Each kind is thinned by a hash of the id to its bound in
    expectation, so the sample is spread over all sources and the same at each run.
    """
    marks = (labels.where(learn).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col) == 1).alias("_good"))
             .where("_good is not null"))
    n_good, n_marked = marks.agg(F.sum(F.col("_good").cast("int")), F.count("*")).first()
    n_all = docs.where(learn).count()
    n_good = n_good or 0
    prior = min(0.98, max(0.02, (n_good + 1) / (n_marked + 2)))
    at = (F.pmod(F.xxhash64(F.col("_id"), F.lit(11)), F.lit(1 << 30)) / F.lit(1 << 30))
    other = (F.pmod(F.xxhash64(F.col(id_col), F.lit(12)), F.lit(1 << 30)) / F.lit(1 << 30))
    chosen = marks.where(F.col("_good") & (at < F.lit(positives / max(1, n_good)))).select("_id")
    texts = docs.where(learn).select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"), other.alias("_at"))
    # the chosen positives are at most about `positives` ids: small whatever the input
    marked = texts.join(F.broadcast(chosen.withColumn("_p", F.lit(True))), "_id", "left")
    rate = unlabelled / max(1, n_all)
    picked = marked.where(F.col("_p").isNotNull() | (F.col("_at") < F.lit(rate)))
    kinds = F.array(*[F.when(c, F.lit(k)) for c, k in ((F.col("_p").isNotNull(), True), (F.col("_at") < F.lit(rate), False))])
    rows = _feature_rows(picked.select("_text", F.explode(F.array_compact(kinds)).alias("positive")))
    rows.sort(key=lambda r: (r[0], r[1].tobytes()))  # the fit does not depend on the order of arrival
    pos = np.array([x for p, x in rows if p], np.float32).reshape(-1, N_FEATURES)
    unl = np.array([x for p, x in rows if not p], np.float32).reshape(-1, N_FEATURES)
    return fit_pu(pos, unl, prior)


def score_quality(docs: DataFrame, model: PuModel, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with a double in 0..1, higher where a positive label is likelier.

    Only the text is read: a null text is empty, an empty one gets the score of its zero
    features. Rows keep all their columns; ``out_col`` replaces a column of that name.
    """
    kept = docs.drop(out_col)
    schema = StructType([*kept.schema.fields, StructField(out_col, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(text_col)
            x = np.array([features(t or "") for t in b.column(at).to_pylist()], np.float32).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.score(x), pa.float64())], [*b.schema.names, out_col])

    return kept.mapInArrow(run, schema)


def quality_model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> PuModel:
    """The model of the given labels: rows whose fold of 5 is 0 stay out of the fit."""
    return train(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)


@query("op1_quality_pu")
def op1_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, quality_model(spark, sf_dir, docs))
    return scored.select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
