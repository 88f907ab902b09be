"""Quality classifier: a convolutional network over the bytes of a text, in numpy.

A text is cut into chunks of CHUNK bytes that overlap by OVERLAP, from its first byte to its last. Bytes become
vectors, learned filters look at every WIDTH neighbouring ones, and the largest response of each filter in a
chunk is kept (a chunk that repeats itself answers few filters). The means and the maxima of these over
all chunks of the text go through a small hidden layer to one probability. Chunks are worked
off in groups of fixed size, so memory doesn't grow with the length of a text.

The network is fitted on at most SAMPLE_ROWS labelled texts, those whose ids hash lowest, and at most
SAMPLE_CHUNKS evenly spaced chunks of each; tasks cut those chunks out, so the driver gets a few KB a text.
Scores are made of whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, ragged, table, text_bytes

#: Labelled texts, and chunks of each, that the network is fitted on at most.
SAMPLE_ROWS, SAMPLE_CHUNKS = 6000, 16
#: A multiple of WIDTH; neighbouring chunks share OVERLAP bytes.
CHUNK, OVERLAP = 256, 32
WIDTH, DEPTH, FILTERS, HIDDEN = 8, 8, 32, 16
#: Chunks that are worked off at once.
GROUP = 512
STEPS, BATCH, RATE, DECAY, SEED = 900, 48, 4e-3, 1e-4, 7
#: Scores from here on count as good.
GOOD = 0.7
#: The symbol after a text's end, whose vector is 0.
PAD = 256


@dataclass
class Network:
    """of_byte[symbol]: its vector; filters[place * DEPTH + d, f] and their offsets; the hidden layer; the last."""

    of_byte: np.ndarray
    filters: np.ndarray
    offset: np.ndarray
    hidden: np.ndarray
    hidden_offset: np.ndarray
    last: np.ndarray
    last_offset: np.ndarray

    @staticmethod
    def start(rng: np.random.Generator) -> Network:
        some = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        of_byte = some(PAD + 1, DEPTH, scale=0.5)
        of_byte[PAD] = 0
        zeros = lambda n: np.zeros(n, np.float32)
        return Network(of_byte, some(WIDTH * DEPTH, FILTERS, scale=(WIDTH * DEPTH) ** -0.5), zeros(FILTERS), some(2 * FILTERS, HIDDEN, scale=(2 * FILTERS) ** -0.5), zeros(HIDDEN), some(HIDDEN, scale=HIDDEN**-0.5), zeros(1))

    def parts(self) -> list[np.ndarray]:
        return [self.of_byte, self.filters, self.offset, self.hidden, self.hidden_offset, self.last, self.last_offset]

    def responses(self, chunks: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """The largest response of each filter in each chunk, not below 0, and where it is on demand.

        Windows that start WIDTH bytes apart stand one after another in memory, so each of the WIDTH first
        places is one matrix product without copies. Those that reach into the next chunk are left out."""
        n = len(chunks)
        flat = np.zeros((n * CHUNK + WIDTH, DEPTH), np.float32)
        np.take(self.of_byte, chunks.ravel(), axis=0, out=flat[: n * CHUNK])
        flat = flat.ravel()
        best = np.full((n, FILTERS), -np.inf, np.float32)
        place = np.zeros((n, FILTERS), np.int64) if where else None
        for first in range(WIDTH):
            windows = flat[first * DEPTH : (first + n * CHUNK) * DEPTH].reshape(-1, WIDTH * DEPTH)
            got = (windows @ self.filters).reshape(n, CHUNK // WIDTH, FILTERS)
            got = got[:, :-1] if first else got
            if where:
                at = got.argmax(axis=1)
                value = np.take_along_axis(got, at[:, None], axis=1)[:, 0]
                place = np.where(value > best, at * WIDTH + first, place)
            else:
                value = got.max(axis=1)
            np.maximum(best, value, out=best)
        return np.maximum(best + self.offset, 0), place

    def log_odds(self, mean: np.ndarray, most: np.ndarray) -> np.ndarray:
        return np.maximum(np.concatenate([mean, most], axis=1) @ self.hidden + self.hidden_offset, 0) @ self.last + self.last_offset

    def gradient(self, chunks: np.ndarray, at: np.ndarray, good: np.ndarray) -> list[np.ndarray]:
        """Of the mean log-loss of the texts whose chunks are chunks[at[i] : at[i + 1]]."""
        n, sizes = len(good), np.diff(at).astype(np.float32)
        found, place = self.responses(chunks, True)
        mean, most = np.add.reduceat(found, at[:-1]) / sizes[:, None], np.maximum.reduceat(found, at[:-1])
        both = np.concatenate([mean, most], axis=1)
        inner = np.maximum(both @ self.hidden + self.hidden_offset, 0)
        error = (1 / (1 + np.exp(-(inner @ self.last + self.last_offset))) - good).astype(np.float32) / n
        of_inner = error[:, None] * self.last * (inner > 0)
        of_both = of_inner @ self.hidden.T
        text = np.repeat(np.arange(n), np.diff(at))
        top = found == most[text]
        shared = np.add.reduceat(top.astype(np.float32), at[:-1])
        of_found = (of_both[:, :FILTERS] / sizes[:, None])[text] + top * (of_both[:, FILTERS:] / shared)[text]
        of_found *= found > 0
        symbols = chunks[np.arange(len(chunks))[:, None, None], place[:, :, None] + np.arange(WIDTH)]
        windows = self.of_byte[symbols].reshape(len(chunks), FILTERS, WIDTH * DEPTH)
        of_filters = np.einsum("cf,cfd->df", of_found, windows, optimize=True)
        of_windows = (of_found[:, :, None] * self.filters.T).reshape(-1, DEPTH)
        flat = symbols.ravel()
        of_byte = np.stack([np.bincount(flat, of_windows[:, d], PAD + 1) for d in range(DEPTH)], axis=1).astype(np.float32)
        of_byte[PAD] = 0
        return [of_byte, of_filters, of_found.sum(axis=0), both.T @ of_inner, of_inner.sum(axis=0), inner.T @ error, error.sum(keepdims=True)]


def chunk_starts(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many chunks texts of these sizes have, and where each chunk starts in its text. An empty text has one."""
    n = 1 + np.maximum(0, -(-(size - CHUNK) // (CHUNK - OVERLAP)))
    return n, ragged(np.zeros(len(n), np.int64), n) * (CHUNK - OVERLAP)


def chunks_at(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The symbols of the chunks that start at `starts` in texts that end at `ends`."""
    at = starts[:, None] + np.arange(CHUNK)
    if not len(data):
        return np.full(at.shape, PAD, np.int16)
    return np.where(at < ends[:, None], data[np.minimum(at, len(data) - 1)], np.int16(PAD))


def _picked(batches):
    """(id, good, size, chunks): evenly spaced chunks of each text; their symbols as 16-bit numbers."""
    for b in batches:
        data, offsets = text_bytes(b.column(2))
        for i in range(len(b)):
            size = offsets[i + 1] - offsets[i]
            n, starts = chunk_starts(np.array([size]))
            some = np.unique(np.linspace(0, n[0] - 1, min(SAMPLE_CHUNKS, int(n[0]))).round().astype(np.int64))
            chunks = chunks_at(data[offsets[i] : offsets[i + 1]], starts[some], np.full(len(some), size))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), b.column(1).slice(i, 1), pa.array([chunks.astype("<i2").tobytes()], pa.binary())], ["id", "good", "chunks"])


def fit(chunks: np.ndarray, at: np.ndarray, good: np.ndarray, steps: int = STEPS) -> Network:
    """Fits a network by Adam to texts whose chunks are chunks[at[i] : at[i + 1]]; the same for the same input."""
    rng = np.random.default_rng(SEED)
    net = Network.start(rng)
    if not len(good):
        return net
    share = (good.sum() + 1) / (len(good) + 2)
    net.last_offset[:] = np.log(share / (1 - share))
    first, second, order = [np.zeros_like(p) for p in net.parts()], [np.zeros_like(p) for p in net.parts()], np.zeros(0, np.int64)
    for step in range(1, steps + 1):
        while len(order) < BATCH:
            order = np.append(order, rng.permutation(len(good)))
        mine, order = order[:BATCH], order[BATCH:]
        sizes = np.diff(at)[mine]
        grads = net.gradient(chunks[ragged(at[mine], sizes)], np.append(0, np.cumsum(sizes)), good[mine])
        rate = RATE * min(1.0, step / 50) * (1 - step / (steps + 1))
        for p, g, u, v in zip(net.parts(), grads, first, second, strict=True):
            u += 0.1 * (g - u)
            v += 0.001 * (g * g - v)
            p -= rate * (u / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8) + DECAY * p)
    return net


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from fitting; a null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, good: Column, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, steps: int = STEPS) -> Network:
    """Fits a network on labelled texts whose ids aren't held out. `good`: a column over `labels` that is 1 or 0;
    rows with a null there or a null id are left out. Of labels that repeat an id the largest counts, and
    documents that repeat one all take part. Without labels every score is near 0.5."""
    y = labels.select(F.col(id_col).alias("id"), good.cast("int").alias("good")).dropna().filter(~held_out(F.col("id")))
    y = y.groupBy("id").agg(F.max("good").alias("good")).orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(y), "id").select("id", "good", "text")  # at most sample_rows short rows
    got = texts.mapInArrow(_picked, f"id {texts.schema['id'].dataType.simpleString()}, good int, chunks binary").toArrow()  # at most SAMPLE_CHUNKS of each
    rows = sorted(zip(got.column("id").to_pylist(), got.column("chunks").to_pylist(), got.column("good").to_pylist(), strict=True), key=lambda r: r[:2])
    sizes = np.array([len(r[1]) // (2 * CHUNK) for r in rows], np.int64)
    symbols = np.frombuffer(b"".join(r[1] for r in rows), "<i2").reshape(-1, CHUNK)
    return fit(symbols, np.append(0, np.cumsum(sizes)), np.array([r[2] for r in rows], np.float32), steps)


def _score(shared):
    def run(batches):
        net: Network = shared.value
        for b in batches:
            data, offsets = text_bytes(b.column(1))
            n_chunks, starts = chunk_starts(np.diff(offsets))
            text = np.repeat(np.arange(len(b)), n_chunks)
            starts += offsets[text]
            total, most = np.zeros((len(b), FILTERS), np.float32), np.zeros((len(b), FILTERS), np.float32)
            for first in range(0, len(text), GROUP):
                own = text[first : first + GROUP]
                found, _ = net.responses(chunks_at(data, starts[first : first + GROUP], offsets[own + 1]))
                new = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                total[own[new]] += np.add.reduceat(found, new)
                most[own[new]] = np.maximum(most[own[new]], np.maximum.reduceat(found, new))
            odds = net.log_odds(total / n_chunks[:, None], most).astype(np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(odds, -500, 500))), pa.float64())], ["doc_id", "score"])
            give_back()

    return run


def score_quality(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, and score, the probability that the text is good. A null text counts as
    empty; empty texts have a score too. Equal texts have equal scores, repeated rows are rows like any
    other, an empty table gives an empty result, and other columns aren't looked at, whatever their names."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(net)), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels"), F.col("quality")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


QUERIES = {"op13_quality_classifier": op13_quality_classifier}
ORACLE_SQL: dict[str, str] = {}
