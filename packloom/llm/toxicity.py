"""Toxicity by a classifier chain over hashed words and word beginnings.

The chain has a logistic regression for each category, in order; each later model also
sees the log-odds of the earlier categories, out of fold while it is trained, so that it
learns from predictions as good as those it will see. Spark counts features per category and fold
over the training sample and picks those that tell most: of all folds for the final models, and
for each out-of-fold model of the others alone, so that no label of a document has a part in its own
out-of-fold prediction. Only documents' picked features reach the driver, where the small models are
fitted. The training sample is bounded: SAMPLE_ROWS labelled documents, those whose ids hash
lowest; a document's fold is a hash of its id too.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, Stored, chunks_of, fold, mix, packed, ragged, table, text_bytes, word_hashes, words_of

#: Labelled rows that the chain is fitted on at most.
SAMPLE_ROWS = 20_000
FEATURES, LEAST_DOCS, FOLDS, L2 = 2048, 4, 4, 0.1
#: Bytes of a word's beginnings that are features beside the whole word.
BEGINNINGS = (4, 5, 6)


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text number and feature of every word and every beginning."""
    data = fold(data)
    starts, ends, at = words_of(data, offsets, ALNUM)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(at))
    rows, keys = [row], [word_hashes(data, starts, ends)]
    for k in BEGINNINGS:
        long = ends - starts >= k
        rows.append(row[long])
        keys.append(mix(word_hashes(data, starts[long], starts[long] + k) + np.uint64(k)))
    return np.concatenate(rows), np.concatenate(keys)


def _feature_lists(batches):
    for b in batches:
        data, offsets = text_bytes(b.column(1))
        for first, past in chunks_of(offsets):
            rows, keys = _features(data[offsets[first] : offsets[past]], offsets[first : past + 1] - offsets[first])
            order = np.lexsort((keys, rows))
            rows, keys = rows[order], keys[order]
            new = np.append(True, (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1])) if len(rows) else np.zeros(0, bool)
            at = np.searchsorted(rows[new], np.arange(past - first + 1))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(first, past - first), packed(keys[new].view(np.int64), at, pa.int64())], ["labels", "features"])


@dataclass
class Chain:
    """keys: sorted features; weights[c][f], bias[c], and prior[c][d] on the log-odds of
    the categories d before c."""

    keys: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    prior: np.ndarray

    def log_odds(self, rows: np.ndarray, features: np.ndarray, n: int) -> np.ndarray:
        """Log-odds of n texts from pairs of a text and the number of a feature it has."""
        out = np.zeros((len(self.bias), n))
        for c in range(len(self.bias)):
            out[c] = self.bias[c] + np.bincount(rows, self.weights[c][features], n) + self.prior[c][:c] @ np.clip(out[:c], -10, 10)
        return out


def _fit(rows, cols, extra, y, k, l2=L2, rounds=80):
    """Logistic regression (weights of k sparse 0/1 features, of the dense rows of `extra`,
    and bias) by L-BFGS on the penalised log-loss."""
    n, d = len(y), len(extra)
    rate = (y.sum() + 0.5) / (n + 1)

    def loss(w):
        z = np.bincount(rows, w[:k][cols], n) + w[k : k + d] @ extra + w[-1]
        error = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - y
        value = np.logaddexp(0, z).sum() - y @ z + 0.5 * l2 * (w[:-1] @ w[:-1])
        return value, np.concatenate([np.bincount(cols, error[rows], k), extra @ error, [error.sum()]]) + l2 * np.append(w[:-1], 0)

    w = np.zeros(k + d + 1)
    w[-1] = np.log(rate / (1 - rate))
    value, grad = loss(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        q, used = grad.copy(), []
        for s, t in reversed(past):
            a = (s @ q) / (s @ t)
            used.append(a)
            q -= a * t
        q *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, np.abs(grad).max())
        for (s, t), a in zip(past, reversed(used), strict=True):
            q += s * (a - (t @ q) / (s @ t))
        step, slope = 1.0, grad @ q
        while (new := loss(w - step * q))[0] > value - 1e-4 * step * slope and step > 1e-8:
            step /= 2
        s, t = -step * q, new[1] - grad
        w, gain, (value, grad) = w + s, value - new[0], new
        if s @ t > 1e-10:
            past = [*past[-7:], (s, t)]
        if gain < 1e-6 * n**0.5:
            break
    return w[:k], w[k : k + d], w[-1]


def fit_chain(docs: DataFrame, labels: DataFrame, targets: dict[str, str], id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, features: int = FEATURES) -> Chain:
    """Fits the chain. targets: category -> SQL expression over `labels` that is 1 or 0;
    rows with a null target or id are left out. Of labels that repeat an id the largest count, and
    documents that repeat one all take part. With no labelled rows every probability is near 0.
    Ties between features or sampled ids go by their hashes, so the chain doesn't depend on
    the order of rows."""
    kept = Stored(docs.sparkSession, "toxicity")
    names = list(targets)
    y = labels.select(F.col(id_col).alias("id"), *[F.expr(e).cast("int").alias(f"y{i}") for i, e in enumerate(targets.values())]).dropna()
    y = y.groupBy("id").agg(*[F.max(f"y{i}").alias(f"y{i}") for i in range(len(names))])
    sample = F.broadcast(y.orderBy(F.xxhash64("id"), "id").limit(sample_rows))  # at most sample_rows short rows
    key = F.xxhash64(F.lit("fold"), "id").alias("key")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(sample, "id").select(F.struct(key, *[f"y{i}" for i in range(len(names))]).alias("labels"), "text")
    schema = T.StructType([rows.schema["labels"], T.StructField("features", T.ArrayType(T.LongType()))])
    rows = kept.put(rows.mapInArrow(_feature_lists, schema))
    fold = F.pmod("labels.key", F.lit(FOLDS))
    of_fold = lambda value, f: F.sum(F.when(fold == f, value).otherwise(0))
    ys = [F.col(f"labels.y{i}") for i in range(len(names))]
    sums = lambda: [of_fold(v, f).alias(f"n{f}_{i}") for f in range(FOLDS) for i, v in enumerate([F.lit(1), *ys])]
    totals = rows.agg(*sums()).first().asDict()
    if not any(totals.values()):
        return Chain(np.zeros(0, np.uint64), np.zeros((len(names), 0)), np.full(len(names), -20.0), np.zeros((len(names), len(names))))
    counts = kept.put(rows.select("labels", F.explode("features").alias("f")).groupBy("f").agg(*sums()))

    def telling(c: int, without: int | None) -> set[int]:
        """The features that tell most of category c in all folds but one."""
        folds = [f for f in range(FOLDS) if f != without]
        n, hit = (sum((F.col(f"n{f}_{i}") for f in folds), F.lit(0)) for i in (0, 1 + c))
        all_, rate = sum(totals[f"n{f}_0"] or 0 for f in folds), sum(totals[f"n{f}_{1 + c}"] or 0 for f in folds)
        if not all_:
            return set()
        rate /= all_
        tells = F.pow(hit - n * rate, 2) / (n * rate * (1 - rate) * (1 - n / all_) + 1)
        return {r.f for r in counts.filter(n >= LEAST_DOCS).orderBy(tells.desc(), "f").limit(features // len(names)).select("f").collect()}

    # The last category's predictions feed no other, so it needs none out of fold.
    models = [(c, f) for c in range(len(names)) for f in [None, *(range(FOLDS) if c + 1 < len(names) else ())]]
    picked = {m: telling(*m) for m in models}
    whole = set().union(*(picked[c, None] for c in range(len(names))))
    keys = np.sort(np.array(sorted(set().union(*picked.values())), np.int64).view(np.uint64))
    shared = docs.sparkSession.sparkContext.broadcast(keys)
    few = rows.mapInArrow(_picked(shared), schema).toArrow()  # at most sample_rows, of picked features
    shared.destroy()
    kept.drop(rows, counts)
    labelled, lists = few.column("labels").combine_chunks(), few.column("features").combine_chunks()
    key = labelled.field("key").to_numpy(zero_copy_only=False)
    order = np.argsort(key, kind="stable")
    n, sizes = len(order), lists.value_lengths().to_numpy(zero_copy_only=False)[order]
    at_row = np.repeat(np.arange(n), sizes)
    at_col = lists.values.to_numpy(zero_copy_only=False)[ragged(lists.offsets.to_numpy()[:-1][order], sizes)]
    truth = np.stack([labelled.field(f"y{i}").to_numpy(zero_copy_only=False)[order] for i in range(len(names))]).astype(float)
    fold_of = key[order] % FOLDS

    def only(rows_: np.ndarray, cols: np.ndarray, allowed: set[int]) -> tuple[np.ndarray, np.ndarray]:
        mine = np.isin(keys, np.array(sorted(allowed), np.int64).view(np.uint64))[cols]
        return rows_[mine], cols[mine]

    k = len(keys)
    weights, bias, prior, seen = np.zeros((len(names), k)), np.zeros(len(names)), np.zeros((len(names), len(names))), np.zeros((0, n))
    for c in range(len(names)):
        weights[c], prior[c, :c], bias[c] = _fit(*only(at_row, at_col, whole), seen, truth[c], k)
        if c + 1 < len(names):
            unseen = np.zeros(n)
            for f in range(FOLDS):
                train = fold_of != f
                number = np.cumsum(train) - 1
                mine = train[at_row]
                w, v, b = _fit(*only(number[at_row[mine]], at_col[mine], picked[c, f]), seen[:, train], truth[c][train], k)
                z = np.bincount(at_row, w[at_col], n) + v @ seen + b
                unseen[~train] = z[~train]
            seen = np.vstack([seen, np.clip(unseen, -10, 10)])
    return Chain(keys, weights, bias, prior)


def _picked(shared):
    def run(batches):
        keys = shared.value
        for b in batches:
            lists = b.column(1)
            got = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            near = np.minimum(np.searchsorted(keys, got), max(len(keys) - 1, 0))
            hit = keys[near] == got if len(keys) else np.zeros(len(got), bool)
            at = np.searchsorted(row[hit], np.arange(len(lists) + 1))
            yield pa.RecordBatch.from_arrays([b.column(0), packed(near[hit], at, pa.int64())], ["labels", "features"])

    return run


def _score(shared):
    def run(batches):
        chain = shared.value
        for b in batches:
            data, offsets = text_bytes(b.column(1))
            found = []
            for first, past in chunks_of(offsets):
                rows, keys = _features(data[offsets[first] : offsets[past]], offsets[first : past + 1] - offsets[first])
                n, k = past - first, len(chain.keys)
                if k:
                    near = np.minimum(np.searchsorted(chain.keys, keys), k - 1)
                    hit = chain.keys[near] == keys
                    pair = np.unique(rows[hit] * k + near[hit])
                    rows, near = pair // k, pair % k
                else:
                    rows = near = np.zeros(0, np.int64)
                found.append(1 / (1 + np.exp(-np.clip(chain.log_odds(rows, near, n), -500, 500))))
            p = np.concatenate(found, axis=1) if found else np.zeros((len(chain.bias), 0))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), packed(p.T.ravel(), np.arange(len(b) + 1) * len(p), pa.float64()), b.column(2)], ["doc_id", "text", "p", "row"])

    return run


def score_chain(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, text, p (a probability per category), and row, a
    struct of the columns of `docs` but the text. A null or empty text has no features."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.struct(*[c for c in docs.columns if c != text_col]).alias("row"))
    kind = {f.name: f.dataType for f in rows.schema.fields}
    schema = T.StructType([T.StructField("doc_id", kind["doc_id"]), T.StructField("text", T.StringType()), T.StructField("p", T.ArrayType(T.DoubleType())), T.StructField("row", kind["row"])])
    return rows.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(chain)), schema)


#: The label table's columns as categories of the chain.
TARGETS = {"low_quality": "1 - quality", "toxic": "toxic"}


def score_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """score_chain() over `docs` by a chain fitted on the labelled ones of `documents`."""
    return score_chain(docs, fit_chain(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), TARGETS))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_toxicity(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), sf_dir)
    return scored.select("doc_id", F.col("p")[0].alias("p_low_quality"), F.col("p")[1].alias("p_toxic"), (F.col("p")[1] >= 0.5).alias("toxic"))


QUERIES = {"op8_toxicity": op8_toxicity}
ORACLE_SQL: dict[str, str] = {}
