"""Quality classifier: random-indexing word vectors, pooled per document, and a small network.

Random indexing: every word has a sparse index vector of a few +1 and -1 that follows from a hash.  A
word's own vector is the sum of the index vectors that stand in a window around its
occurrences, itself included, over *all* documents, scaled to length 1.  Words are kept in
``buckets`` hash buckets, so the table of vectors has a fixed size (8 MB) however large the vocabulary: each task adds up what it
reads in integers and hands on its sums by ranges of buckets, tasks add those up, and the finished table is broadcast.  A document is
the mean and the spread of the vectors of its words, and the logarithm of its length.

A two-layer network (tanh) learns on at most ``fit_rows`` labelled documents; some of
them, by a hash, are held back to find the temperature that makes its probabilities
agree with the labels.  Every text is scored.

Words are runs of letters and digits in lower case and runs of marks.  All words in
capitals are one word, so is a word that repeats the one before it.  Windows end at pieces of a
million characters in very long texts.

Edge cases: null and empty texts have no words, pool to zeros and get the probability of
that.  Without labels of both classes every score is the share of label 1 (0.5 without
labels).  A document with several labels is poor if one says so; labels without a mark are not
used.  Of labelled rows that share an id one is fitted.  Repeated rows are judged one by one, so is a null id (which never has a label).
Empty tables give an empty result.  Of the documents only ``doc_id`` and ``text`` are read, of
the labels ``doc_id`` and ``quality``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrina.llm.common import cut_lineage, slices, text_bytes

_TOKEN = re.compile(r"[^\W_]+|(?:[^\w\s]|_)+")
_PIECE = 1 << 20
#: Buckets of the words that aren't hashed.
_CAPITALS, _ECHO, _RESERVED = 0, 1, 2
_REMEMBERED = 500_000
#: Buckets that are added up together.
_RANGE = 1024


@dataclass(frozen=True)
class QualitySettings:
    buckets: int = 1 << 15          #: hash buckets of words
    dimensions: int = 64            #: of index and word vectors
    marks: int = 4                  #: entries of an index vector that are not 0
    window: int = 2                 #: words to either side
    fit_rows: int = 20_000          #: labelled documents used to fit, the first by a hash of the id
    hidden: int = 32                #: units of the first layer
    epochs: int = 60
    batch: int = 128
    rate: float = 0.003
    decay: float = 0.0005
    held_back: float = 0.2          #: share of them that only sets the temperature


def index_vectors(settings: QualitySettings) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the entries of each bucket's index vector; one more row, all zero, stands between documents."""
    draw = np.random.default_rng(20_011)
    places = draw.integers(0, settings.dimensions, (settings.buckets + 1, settings.marks))
    signs = draw.choice(np.array([-1.0, 1.0]), (settings.buckets + 1, settings.marks))
    signs[-1] = 0
    return places, signs


class WordReader:
    """Texts to bucket numbers; remembers the words it has seen."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.known: dict[str, int] = {}

    def _bucket(self, word: str) -> int:
        if len(word) > 1 and word.isupper():
            return _CAPITALS
        return _RESERVED + zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % (self.buckets - _RESERVED)

    def read(self, text: bytes) -> Iterator[np.ndarray]:
        """The bucket numbers of a text's words, piece by piece."""
        whole, start = text.decode("utf-8", "replace"), 0
        while start < len(whole):
            end = start + _PIECE
            if end < len(whole):
                end = max(whole.rfind(" ", start, end), whole.rfind("\n", start, end)) + 1 or end
            words = _TOKEN.findall(whole[start:end])
            new = set(words).difference(self.known)
            if len(self.known) + len(new) > _REMEMBERED:
                self.known.clear()
                new = set(words)
            self.known.update((w, self._bucket(w)) for w in new)
            numbers = np.array(list(map(self.known.__getitem__, words)), np.int64)
            numbers[1:][numbers[1:] == numbers[:-1]] = _ECHO
            yield numbers
            start = end


def word_vectors(docs: DataFrame, settings: QualitySettings = QualitySettings()) -> np.ndarray:
    """The table of word vectors, ``buckets`` by ``dimensions``, from all of ``docs``."""
    n, width = settings.buckets, settings.dimensions

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, (places, signs) = WordReader(n), index_vectors(settings)
        total = np.zeros((n + 1) * width)
        gap = np.full(settings.window, n)

        def add(parts: list[np.ndarray]) -> None:
            words = np.concatenate(parts)
            for shift in range(-settings.window, settings.window + 1):
                near, word = words[max(0, shift):len(words) + min(0, shift)], words[max(0, -shift):len(words) + min(0, -shift)]
                for k in range(settings.marks):
                    total[:] += np.bincount(word * width + places[near, k], signs[near, k], len(total))

        parts, held = [], 0
        for batch in slices(batches):
            for text in batch.column(0):
                for numbers in reader.read(text.as_py()):
                    parts += [numbers, gap]
                    held += len(numbers) + len(gap)
                    if held > 1 << 20:
                        add(parts)
                        parts, held = [], 0
        if parts:
            add(parts)
        sums = total.reshape(-1, width)[:n]
        for low in range(0, n, _RANGE):
            part = sums[low:low + _RANGE].astype("<i4")
            if part.any():
                yield pa.RecordBatch.from_pydict({"low": pa.array([low]), "sums": pa.array([pa.compress(part.tobytes(), codec="zstd", asbytes=True)])})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for low, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = min(_RANGE, n - low)
                raw = pa.decompress(data.as_py(), decompressed_size=4 * rows * width, codec="zstd", asbytes=True)
                held.setdefault(low, np.zeros((rows, width), "<i8"))
                held[low] += np.frombuffer(raw, "<i4").reshape(rows, width)
        for low, sums in held.items():
            yield pa.RecordBatch.from_pydict({"low": pa.array([low]), "sums": pa.array([sums.tobytes()])})

    partial = docs.select(text_bytes().alias("text")).mapInArrow(add_up, "low long, sums binary")
    table = np.zeros((n, width), np.float32)
    for row in partial.repartition("low").mapInArrow(merge, "low long, sums binary").collect():
        sums = np.frombuffer(row["sums"], "<i8").reshape(-1, width).astype(np.float64)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        table[row["low"]:row["low"] + len(sums)] = sums / np.where(length > 0, length, 1)
    return table


def pooled(docs: DataFrame, keep: str, vectors: np.ndarray, settings: QualitySettings, network: "Network | None" = None) -> DataFrame:
    """``keep`` and the pooled vector (``features``, 32-bit floats) of each text, or with a ``network`` its ``score``."""
    table = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, rows = WordReader(settings.buckets), table.value
        for batch in slices(batches):
            out = []
            for text in batch.column(1):
                total, square, n = np.zeros(settings.dimensions), np.zeros(settings.dimensions), 0
                for numbers in reader.read(text.as_py()):
                    for start in range(0, len(numbers), 1 << 14):
                        found = rows[numbers[start:start + (1 << 14)]]
                        total += found.sum(axis=0)
                        square += np.einsum("ij,ij->j", found, found)
                    n += len(numbers)
                mean = total / max(1, n)
                spread = np.sqrt(np.maximum(0, square / max(1, n) - mean * mean))
                out.append(np.concatenate([mean, spread, [np.log1p(n)]]))
            if out:
                features = np.array(out)
                if network is not None:
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(network.probability(features))], names=[keep, "score"])
                else:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0), pa.array([f.astype("<f4").tobytes() for f in features], pa.binary())], names=[keep, "features"])

    found = "score double" if network is not None else "features binary"
    kind = docs.schema[keep].dataType.simpleString()
    return docs.select(keep, text_bytes().alias("text")).mapInArrow(run, f"`{keep}` {kind}, {found}")


@dataclass
class Network:
    """Scaled features, a tanh layer, a logit divided by the temperature."""

    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float = 1.0

    def logit(self, features: np.ndarray) -> np.ndarray:
        first, bias, second, last = self.layers
        return (np.tanh((features - self.mean) / self.scale @ first + bias) @ second + last).ravel()

    def probability(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(features) / self.temperature, -40, 40)))


def train_network(features: np.ndarray, labels: np.ndarray, settings: QualitySettings) -> Network:
    """Weights by Adam on the logistic loss."""
    draw = np.random.default_rng(7)
    width = features.shape[1]
    scale = features.std(axis=0)
    net = Network(features.mean(axis=0), np.where(scale > 1e-9, scale, 1.0), [
        draw.normal(0, 1 / np.sqrt(width), (width, settings.hidden)), np.zeros(settings.hidden),
        draw.normal(0, 1 / np.sqrt(settings.hidden), (settings.hidden, 1)), np.zeros(1)])
    x, y = (features - net.mean) / net.scale, labels.astype(float)[:, None]
    first_moment, second_moment = ([np.zeros_like(w) for w in net.layers] for _ in range(2))
    step = 0
    for _ in range(settings.epochs):
        order = draw.permutation(len(x))
        for at in range(0, len(x), settings.batch):
            part = order[at:at + settings.batch]
            a, bias, b, last = net.layers
            inner = np.tanh(x[part] @ a + bias)
            error = (1 / (1 + np.exp(-np.clip(inner @ b + last, -40, 40))) - y[part]) / len(part)
            back = (error @ b.T) * (1 - inner * inner)
            slopes = [x[part].T @ back + settings.decay * a, back.sum(axis=0), inner.T @ error + settings.decay * b, error.sum(axis=0)]
            step += 1
            for w, slope, m, v in zip(net.layers, slopes, first_moment, second_moment, strict=True):
                m += 0.1 * (slope - m)
                v += 0.001 * (slope * slope - v)
                w -= settings.rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return net


def calibrate(net: Network, features: np.ndarray, labels: np.ndarray) -> None:
    """Set the temperature of least logistic loss on rows that were not trained on."""
    if not 0 < labels.sum() < len(labels):
        return
    logit, y = net.logit(features), labels.astype(float)

    def loss(temperature: float) -> float:
        z = logit / temperature
        return float(np.mean(np.logaddexp(0, z) - y * z))

    grid = np.exp(np.linspace(np.log(0.25), np.log(16), 200))
    net.temperature = float(min(grid, key=loss))


def fit(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, train: Column | None, settings: QualitySettings) -> Network | float:
    """The fitted network, or the share of label 1 if only one class (0.5 if none) is known."""
    known = (
        (labels.filter(train) if train is not None else labels).filter("doc_id is not null and quality is not null")
        .groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.min((F.col("quality") > 0).cast("int")).alias("good"))
        .orderBy(F.xxhash64("label_id"), "label_id").limit(settings.fit_rows))
    # At most fit_rows pairs of numbers, hence broadcast; and one vector per id reaches the driver.
    known = F.broadcast(cut_lineage(known))
    sample = docs.select(F.col("doc_id").cast("long").alias("label_id"), "text").join(known, "label_id", "left_semi")
    rows = (
        pooled(sample, "label_id", vectors, settings).groupBy("label_id").agg(F.min("features").alias("features"))
        .join(known, "label_id").orderBy("label_id").collect())
    good = np.array([r["good"] for r in rows])
    if not 0 < good.sum() < len(good):
        return float(good.mean()) if len(good) else 0.5
    features = np.array([np.frombuffer(r["features"], "<f4") for r in rows], np.float64)
    back = np.array([zlib.crc32(b"held back %d" % r["label_id"]) % 1000 < 1000 * settings.held_back for r in rows])
    if not 0 < good[~back].sum() < (~back).sum():
        back[:] = False
    net = train_network(features[~back], good[~back], settings)
    calibrate(net, features[back], good[back])
    return net


def score_documents(docs: DataFrame, labels: DataFrame, train: Column | None = None, settings: QualitySettings = QualitySettings(),
                    threshold: float = 0.3) -> DataFrame:
    """``doc_id, score, predicted``: the probability of label 1, and whether it reaches ``threshold``; ``train`` says which labels may be used."""
    vectors = word_vectors(docs, settings)
    fitted = fit(docs, labels, vectors, train, settings)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = keyed.select("doc_id", F.lit(fitted).alias("score")) if isinstance(fitted, float) else pooled(keyed, "doc_id", vectors, settings, fitted)
    return scored.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
