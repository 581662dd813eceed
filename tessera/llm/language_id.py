"""Language identification by a byte convolutional network.

Filters of several widths run over embedded bytes; each filter's largest response in a window feeds a softmax.
The network is trained in numpy on windows of a bounded sample of labelled texts. A text is cut into windows of
fixed length (the last one padded) that cover all of it; windows of many texts are scored in one batch, and a
text's probabilities are its windows' means, weighted by their bytes.

Defined results: ``und`` with score 0 for null text and text without a letter, and for every text when nothing
could be learned; repeated rows get equal results; null doc_id is not held out and not learned from; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 16
PER_LANGUAGE, MOST_ROWS = 300, 6000
"""Labelled texts that the network is fitted on: per language, and in all (twice as many rows, if ids repeat)."""
LEAST_BYTES = 32
"""A window of a fitted piece has at least so many bytes of it, if the piece has."""
UNDETERMINED = "und"
BATCH = 256
PAD = 256


@dataclass
class Network:
    """responses[w][j]: what byte b at place j of a filter of width w adds, for each of the 257 symbols."""

    languages: list[str]
    responses: list[np.ndarray]
    bias: np.ndarray
    weight: np.ndarray
    offset: np.ndarray

    @staticmethod
    def new(languages: list[str], seed: int = 0) -> Network:
        rng = np.random.default_rng(seed)
        f = FILTERS * len(WIDTHS)
        responses = [(rng.standard_normal((w, PAD + 1, FILTERS)) / np.sqrt(w)).astype(np.float32) for w in WIDTHS]
        for r in responses:
            r[:, PAD] = 0
        return Network(languages, responses, np.zeros(f, np.float32), (rng.standard_normal((f, len(languages))) * 0.1).astype(np.float32), np.zeros(len(languages), np.float32))

    def pooled(self, x: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Largest response of each filter in each row of x (uint16 symbols), and where it is."""
        tops, places = [], []
        for w, r in zip(WIDTHS, self.responses, strict=True):
            n = x.shape[1] - w + 1
            total = r[0].take(x[:, :n], axis=0)
            for j in range(1, w):
                total += r[j].take(x[:, j : j + n], axis=0)
            if where:
                at = total.argmax(1)
                places.append(at)
                tops.append(np.take_along_axis(total, at[:, None], 1)[:, 0])
            else:
                tops.append(total.max(1))
        return np.concatenate(tops, 1), np.concatenate(places, 1) if where else None

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = np.maximum(self.pooled(x)[0] + self.bias, 0) @ self.weight + self.offset
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def train(x: np.ndarray, y: np.ndarray, languages: list[str], epochs: int = 6, rate: float = 0.01, seed: int = 0) -> Network:
    """Adam on the cross entropy; only each filter's winning place receives a gradient."""
    net = Network.new(languages, seed)
    rng = np.random.default_rng(seed)
    params = [*net.responses, net.bias, net.weight, net.offset]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    t = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for k in range(0, len(x), 64):
            xb, yb = x[order[k : k + 64]], y[order[k : k + 64]]
            top, at = net.pooled(xb, where=True)
            h = np.maximum(top + net.bias, 0)
            z = h @ net.weight + net.offset
            z = np.exp(z - z.max(1, keepdims=True))
            d = z / z.sum(1, keepdims=True)
            d[np.arange(len(yb)), yb] -= 1
            d /= len(yb)
            dh = (d @ net.weight.T) * (h > 0)
            grads = []
            for i, (w, r) in enumerate(zip(WIDTHS, net.responses, strict=True)):
                g = np.zeros_like(r)
                part, place = dh[:, i * FILTERS : (i + 1) * FILTERS], at[:, i * FILTERS : (i + 1) * FILTERS]
                for j in range(w):
                    symbols = np.take_along_axis(xb, place + j, 1)
                    np.add.at(g[j], (symbols, np.arange(FILTERS)[None]), part)
                    g[j, PAD] = 0
                grads.append(g)
            grads += [dh.sum(0), h.T @ d, d.sum(0)]
            t += 1
            for p, g, a, b in zip(params, grads, m, v, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-7)
    return net


def windows(data: bytes) -> np.ndarray:
    """The whole text as rows of WINDOW symbols; rows overlap by the widest filter less one."""
    step = WINDOW - max(WIDTHS) + 1
    n = max(1, -(-(len(data) - max(WIDTHS) + 1) // step))
    x = np.full(n * step + max(WIDTHS) - 1, PAD, np.uint16)
    x[: len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(x, WINDOW)[::step]


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def fit(docs: DataFrame) -> Network | None:
    """Learns from documents that are not held out and have a lang: per language those with the smallest hashes of
    their id, and of each four pieces of WINDOW characters, spread over its text, with all their bytes."""
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out())
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = known.select("doc_id", "lang").withColumn("__r", F.row_number().over(first)).where(F.col("__r") <= PER_LANGUAGE)
    ids = ids.orderBy("__r", "lang").limit(MOST_ROWS).select(F.col("doc_id").alias("__id"))
    n = F.length("text")
    parts = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.substring(F.col("text"), (n * k / 4).cast("int") + 1, F.lit(WINDOW)))
    rows = known.join(F.broadcast(ids), F.col("doc_id") == F.col("__id"), "left_semi").select("doc_id", "lang", parts.alias("parts")).orderBy("doc_id", "lang", "parts").limit(2 * MOST_ROWS).collect()
    languages = sorted({r["lang"] for r in rows})
    if not languages:
        return None
    x, y = [], []
    for r in rows:
        for part in dict.fromkeys(r["parts"]):
            if part and any(map(str.isalpha, part)):
                rows_of = [w for w in windows(part.encode()) if (w != PAD).sum() >= min(LEAST_BYTES, len(part))]
                x += rows_of
                y += [languages.index(r["lang"])] * len(rows_of)
    return train(np.array(x), np.array(y), languages) if x else None


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owner, rows, size = [], [], 0

            def score_rows() -> None:
                nonlocal rows, size, owner
                if rows:
                    x = np.concatenate(rows)
                    who = np.repeat(np.array(owner), [len(r) for r in rows])
                    for k in range(0, len(x), BATCH):
                        part = x[k : k + BATCH]
                        weight = (part != PAD).sum(1)
                        np.add.at(sums, who[k : k + BATCH], net.probabilities(part) * weight[:, None])
                rows, owner, size = [], [], 0

            texts = b.column(2)
            sums = np.zeros((len(texts), len(net.languages) if net else 1))
            known = np.zeros(len(texts), bool)
            for i, t in enumerate(texts):
                t = t.as_py()
                if net and t and any(map(str.isalpha, t)):
                    known[i] = True
                    rows.append(windows(t.encode()))
                    owner.append(i)
                    size += len(rows[-1])
                    if size >= 8 * BATCH:
                        score_rows()
            score_rows()
            best = sums.argmax(1)
            share = sums.max(1) / np.maximum(sums.sum(1), 1e-300)
            labels = [net.languages[k] if ok else UNDETERMINED for k, ok in zip(best, known, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(labels, pa.string()), pa.array(np.where(known, np.clip(share, 0, 1), 0.0))], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
