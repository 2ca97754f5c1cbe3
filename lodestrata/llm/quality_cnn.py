"""Quality classifier: a byte-level convolutional network in numpy.

Each byte of a text is a symbol: its value, and whether the eight bytes from it on stood within the
last ``ECHO_BYTES`` bytes as well (so that filters can see short-range repetition). Symbols are
embedded, filters of ``WIDTH`` bytes run over them at every ``STRIDE`` bytes, and rectified
responses are max-pooled within overlapping chunks that cover the whole text. The mean and the
greatest of the chunks' maxima go into one logistic unit: one probability for each document.

The network is fitted in one executor task, on at most ``TRAIN_ROWS`` labelled documents (half of
each label, picked by hash); the sampling is undone in the last bias, so scores stay probabilities.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import materialize, short, table

WIDTH, STRIDE, FILTERS, DIM = 12, 4, 24, 8
#: In positions of the filters: a chunk is 1,024 bytes and shares 64 with the next.
CHUNK, STEP = 256, 240
ECHO_BYTES = 48
#: Documents that a model is fitted on, at most.
TRAIN_ROWS = 2048
#: Passes over the sample, more where it is small: ``UPDATES`` steps at least.
EPOCHS, UPDATES, BATCH, RATE = 5, 640, 16, 0.01
THRESHOLD = 0.3
#: Bytes whose repetitions are looked for at once, and chunks whose responses a gradient holds at once.
SYMBOL_STRETCH, GRADIENT_CHUNKS = 1 << 20, 1024
_PAD = 512
_BLOCKS = WIDTH // STRIDE


def symbols_of(text: str | None) -> np.ndarray:
    """Bytes 0 to 255, plus 256 where the next eight bytes repeat recent ones; padded to whole strides."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    n = len(raw)
    out = np.full(max(WIDTH, -(-n // STRIDE) * STRIDE + WIDTH - STRIDE), _PAD, np.int16)
    out[:n] = raw
    # Whether a byte repeats depends on the bytes just before it and the eight from it on, so long texts go in stretches.
    for k in range(0, n - 7, SYMBOL_STRETCH):
        low, high = max(0, k - ECHO_BYTES), min(n - 7, k + SYMBOL_STRETCH)
        code = np.zeros(high - low, np.uint64)
        with np.errstate(over="ignore"):
            for j in range(8):
                code = code * np.uint64(0x9E3779B97F4A7C15) + raw[low + j : high + j]
        short = (code >> np.uint64(48)).astype(np.uint16)
        order = np.argsort(short, kind="stable")
        same = (short[order[1:]] == short[order[:-1]]) & (code[order[1:]] == code[order[:-1]]) & (order[1:] - order[:-1] <= ECHO_BYTES)
        echo = order[1:][same] + low
        out[echo[echo >= k]] += 256
    return out


class ByteNet:
    """The network's weights; ``score`` runs it over one text."""

    NAMES = ("emb", "conv", "bias", "mean_w", "max_w", "out")

    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.emb = rng.normal(0, 0.5, (_PAD + 1, DIM)).astype(np.float32)
        self.emb[_PAD] = 0
        self.conv = rng.normal(0, (WIDTH * DIM) ** -0.5, (WIDTH * DIM, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.mean_w = rng.normal(0, 0.1, FILTERS).astype(np.float32)
        self.max_w = rng.normal(0, 0.1, FILTERS).astype(np.float32)
        self.out = np.zeros(1, np.float32)

    def dumps(self) -> bytes:
        buffer = io.BytesIO()
        np.savez(buffer, **{n: getattr(self, n) for n in self.NAMES})
        return buffer.getvalue()

    @classmethod
    def loads(cls, data: bytes) -> ByteNet:
        net = cls()
        with np.load(io.BytesIO(data)) as held:
            for n in cls.NAMES:
                setattr(net, n, held[n])
        return net

    def responses(self, symbols: np.ndarray) -> np.ndarray:
        """Each filter's response at each position, before bias: the strides' products, shifted and added."""
        blocks = self.emb.take(symbols, axis=0).reshape(len(symbols) // STRIDE, STRIDE * DIM)
        parts = self.conv.reshape(_BLOCKS, STRIDE * DIM, FILTERS)
        n = len(blocks) - _BLOCKS + 1
        total = blocks[:n] @ parts[0]
        for k in range(1, _BLOCKS):
            total += blocks[k : n + k] @ parts[k]
        return total

    @staticmethod
    def starts(n: int) -> np.ndarray:
        """Where chunks begin: enough of them to cover all n positions."""
        return np.arange(max(1, -(-(n - CHUNK + STEP) // STEP))) * STEP

    def score(self, text: str | None) -> float:
        logit = float(self.out[0])
        # Long texts in stretches of whole chunks, so that memory doesn't grow with them.
        symbols = symbols_of(text)
        n = len(symbols) // STRIDE - _BLOCKS + 1
        starts = self.starts(n)
        total, most = np.zeros(FILTERS, np.float64), np.zeros(FILTERS, np.float32)
        for k in range(0, len(starts), 64):
            own = starts[k : k + 64]
            end = min(n, own[-1] + CHUNK)
            got = self.responses(symbols[own[0] * STRIDE : (end + _BLOCKS - 1) * STRIDE])
            local = own - own[0]
            pairs = np.empty(2 * len(local), np.int64)
            pairs[::2], pairs[1::2] = local, np.minimum(local + CHUNK, len(got))
            if pairs[-1] == len(got):
                pairs = pairs[:-1]
            pooled = np.maximum(np.maximum.reduceat(got, pairs, axis=0)[::2] + self.bias, 0)
            total += pooled.sum(axis=0)
            most = np.maximum(most, pooled.max(axis=0))
        logit += float(total / len(starts) @ self.mean_w) + float(most @ self.max_w)
        return float(1.0 / (1.0 + np.exp(-np.clip(logit, -60, 60))))


def fit(texts: list[str], labels: list[int], prior: float, seed: int = 7) -> ByteNet:
    """Adam on the log loss; ``prior`` is the share of label 1 among all labelled rows."""
    net = ByteNet(seed)
    if not texts:
        net.out[0] = np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
        return net
    rng = np.random.default_rng(seed)
    inputs = [symbols_of(t) for t in texts]
    y = np.asarray(labels, np.float32)
    moments = {n: (np.zeros_like(getattr(net, n)), np.zeros_like(getattr(net, n))) for n in net.NAMES}
    step = 0
    epochs = max(EPOCHS, -(-UPDATES * BATCH // len(inputs)))
    for epoch in range(epochs):
        order = rng.permutation(len(inputs))
        for k in range(0, len(order), BATCH):
            grads = {n: np.zeros_like(getattr(net, n)) for n in net.NAMES}
            some = order[k : k + BATCH]
            for i in some:
                _gradient(net, inputs[i], float(y[i]), grads)
            step += 1
            rate = RATE * (1 - (epoch / epochs) ** 2)
            for n, g in grads.items():
                g /= len(some)
                m, v = moments[n]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                getattr(net, n)[...] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            net.emb[_PAD] = 0
    share = float(y.mean())
    if 0 < share < 1 and 0 < prior < 1:
        net.out[0] += np.log(prior / (1 - prior)) - np.log(share / (1 - share))
    return net


def _gradient(net: ByteNet, symbols: np.ndarray, y: float, grads: dict) -> None:
    n = len(symbols) // STRIDE - _BLOCKS + 1
    starts, lane = net.starts(n), np.arange(FILTERS)
    at, pooled = np.empty((len(starts), FILTERS), np.int64), np.empty((len(starts), FILTERS), np.float32)
    for k in range(0, len(starts), GRADIENT_CHUNKS):
        own = starts[k : k + GRADIENT_CHUNKS]
        end = min(n, own[-1] + CHUNK)
        got = net.responses(symbols[own[0] * STRIDE : (end + _BLOCKS - 1) * STRIDE])
        local = own - own[0]
        most_at = np.stack([s + got[s : s + CHUNK].argmax(axis=0) for s in local])
        at[k : k + len(own)] = most_at + own[0]
        pooled[k : k + len(own)] = np.maximum(got[most_at, lane] + net.bias, 0)
    mean, top = pooled.mean(axis=0), pooled.argmax(axis=0)
    most = pooled[top, lane]
    logit = float(mean @ net.mean_w + most @ net.max_w + net.out[0])
    d = 1.0 / (1.0 + np.exp(-np.clip(logit, -60, 60))) - y
    grads["out"] += d
    grads["mean_w"] += d * mean
    grads["max_w"] += d * most
    back = np.tile(d * net.mean_w / len(starts), (len(starts), 1))
    back[top, lane] += d * net.max_w
    back *= pooled > 0
    grads["bias"] += back.sum(axis=0)
    c, f = np.nonzero(back)
    if not len(c):
        return
    for k in range(0, len(c), GRADIENT_CHUNKS * FILTERS):
        some_c, some_f = c[k : k + GRADIENT_CHUNKS * FILTERS], f[k : k + GRADIENT_CHUNKS * FILTERS]
        g = back[some_c, some_f].astype(np.float32)
        window = symbols[at[some_c, some_f][:, None] * STRIDE + np.arange(WIDTH)]
        x = net.emb[window].reshape(len(g), WIDTH * DIM)
        np.add.at(grads["conv"].T, some_f, x * g[:, None])
        np.add.at(grads["emb"], window.ravel(), (net.conv.T[some_f] * g[:, None]).reshape(-1, DIM))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS, seed: int = 7) -> ByteNet:
    """Fit a network on at most ``rows`` of the labelled documents.

    Null labels, null ids and labels without a document take no part; of several labels of one id
    the least counts. Without any the score is 0.5 everywhere.
    """
    spark = docs.sparkSession
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("y"))
    known = materialize(known.join(docs.select(F.col(id_col).alias("id")).distinct(), "id", "left_semi"), "labels")
    total, ones = known.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not total:
        return fit([], [], 0.5, seed)
    picked = [known.where(F.col("y") == v).orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(rows // 2) for v in (0, 1)]
    # At most ``rows`` ids: a bound by construction.
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked[0].unionByName(picked[1])), "id")
    prior = ones / total

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(batches)).sort_values(["id", "text"]).drop_duplicates("id")
        yield pd.DataFrame({"net": [fit(every["text"].tolist(), every["y"].tolist(), prior, seed).dumps()]})

    return ByteNet.loads(bytes(sample.repartition(1).mapInPandas(run, "net binary").first().net))


def score_documents(docs: DataFrame, net: ByteNet, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """One row for each row of ``docs``: id and score; with ``keep`` all columns of ``docs`` and __score.

    Null and empty texts are scored as texts without bytes. Rows repeat as they are; other columns
    are never inputs; an empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(net.dumps())

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = ByteNet.loads(held.value)
        for texts in short(batches):
            yield pd.Series([own.score(t) for t in texts], dtype="float64")

    return docs.withColumn("__score", score(F.col(text_col))) if keep else docs.select(id_col, score(F.col(text_col)).alias("score"))


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = train(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return score_documents(docs, net).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
