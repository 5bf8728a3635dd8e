"""Toxicity by maximum-scoring segments.

Tokens are words in lower case without punctuation at their edges.  A token's score is its
log-odds of standing in a toxic rather than in another document, with an informative
Dirichlet prior whose pseudo-counts follow the class shares of the documents.  A word
whose log-odds are no multiple of their standard error scores as its first letters do,
and those likewise as an average token, which scores just below zero; the k-th time a
word stands in a text it counts for 1/k.  One scan per text finds every maximal scoring
segment (the segments of Ruzzo and Tompa) in linear time.  The best score of a text of ``n`` tokens without toxic passages
follows an extreme-value distribution whose location grows with ``ln n``; it is fitted on
labelled rows of either class and gives the document's probability.  A passage is
significant if its expected number of chance occurrences in a text of that length is at
most ``max_expected``.  A fit uses at most ``fit_rows`` labelled rows; every text is scored.

Edge cases: null and empty texts have no segment and get the probability of score 0.
Without labelled rows of both classes every score is the share of toxic labels (0 if
there are none).  A document with several labels counts as toxic if one says so; labels
without a toxic mark are not used.  Repeated rows are judged one by one, so is a null
id (which never has a label).  Empty tables give an empty result.  Of the documents only
``doc_id`` and ``text`` are read, of the labels ``doc_id`` and ``toxic``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vitrina.llm.common import cut_lineage, fresh, slices, small_batches, text_bytes

_EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”„’‘¡¿…"
_HELD = 200_000


@dataclass(frozen=True)
class ToxicityModel:
    """Scores of tokens and of word beginnings, what others score, and the fitted distributions."""

    words: dict[str, float]
    stems: dict[str, float]
    other: float
    stem_length: int


@dataclass(frozen=True)
class ToxicitySettings:
    stem_length: int = 6            #: letters of a word's beginning
    min_documents: int = 3          #: documents in which a token must stand
    min_z: float = 3.5              #: standard errors that log-odds must differ from 0
    vocabulary: int = 50_000        #: tokens and beginnings kept, those of the largest scores first
    strength: float = 1.0           #: pseudo-documents of the prior
    shift: float = 0.1              #: subtracted from every score
    max_score: float = 6.0          #: largest score of a token
    fit_rows: int = 20_000          #: labelled rows used to fit, the first by a hash of the id
    max_expected: float = 0.05      #: chance occurrences up to which a passage is significant


def tokens(text: str) -> list[str]:
    return [t for t in (w.strip(_EDGES) for w in text.lower().split()) if t]


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(begin, end, score)``, in order (Ruzzo and Tompa 1999).

    ``left`` is the sum before a segment, ``right`` up to its end.  The chain ``back``
    leads to the nearest earlier segment with a smaller left sum, so each is looked at once.
    """
    found: list[list] = []  # begin, end, left, right, back
    total = 0.0
    for i, score in enumerate(scores):
        if score <= 0:
            total += score
            continue
        segment = [i, i + 1, total, total + score, -1]
        total += score
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= segment[2]:
                j = found[j][4]
            if j < 0 or found[j][3] >= segment[3]:
                segment[4] = j
                found.append(segment)
                break
            segment = [found[j][0], segment[1], found[j][2], segment[3], -1]
            del found[j:]
    return [(b, e, r - l) for b, e, l, r, _ in found]


def score_tokens(words: list[str], model: ToxicityModel) -> list[float]:
    known, stems, other, k = model.words, model.stems, model.other, model.stem_length
    scores, times = [], Counter()
    for w in words:
        score = known.get(w)
        if score is None:
            score = stems.get(w[:k], other) if len(w) > k else other
        if score > 0:
            times[w] += 1
            score /= times[w]
        scores.append(score)
    return scores


def class_counts(labelled: DataFrame, settings: ToxicitySettings) -> DataFrame:
    """``token, kind, toxic, clean``: numbers of documents, by word (``w``) and beginning (``s``).

    Tasks add up what they read and hand on a bounded table at a time.
    """
    out = pa.schema([("kind", pa.string()), ("token", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())

        def rows() -> pa.RecordBatch:
            keys = list(counts[0].keys() | counts[1].keys())
            batch = pa.RecordBatch.from_arrays([
                pa.array([k[0] for k in keys]), pa.array([k[1:] for k in keys]),
                pa.array([counts[1][k] for k in keys], pa.int64()), pa.array([counts[0][k] for k in keys], pa.int64()),
            ], schema=out)
            for c in counts:
                c.clear()
            return batch

        for batch in slices(batches):
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = set(tokens(text.decode("utf-8", "replace")))
                counts[toxic].update("w" + w for w in words)
                counts[toxic].update({"s" + w[:settings.stem_length] for w in words if len(w) > settings.stem_length})
                if len(counts[0]) + len(counts[1]) > _HELD:
                    yield rows()
        yield rows()

    return (
        labelled.select(text_bytes().alias("text"), F.col("toxic").cast("int").alias("toxic"))
        .mapInArrow(run, "kind string, token string, toxic long, clean long")
        .groupBy("kind", "token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))


def fit_tokens(labelled: DataFrame, settings: ToxicitySettings = ToxicitySettings()) -> ToxicityModel:
    """Token scores from the labelled rows; at most ``settings.vocabulary`` of them reach the driver."""
    n = labelled.agg(
        F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"), F.coalesce(F.sum(1 - F.col("toxic")), F.lit(0)).alias("clean"),
    ).first()
    if not n["toxic"] or not n["clean"]:
        return ToxicityModel({}, {}, -settings.shift, settings.stem_length)
    share = n["toxic"] / (n["toxic"] + n["clean"])
    toxic, clean = F.col("toxic") + settings.strength * share, F.col("clean") + settings.strength * (1 - share)
    kept = (
        class_counts(labelled, settings).filter(F.col("toxic") + F.col("clean") >= settings.min_documents)
        .select("kind", "token", (F.log(toxic / clean) - math.log(share / (1 - share))).alias("score"),
                F.sqrt(1 / toxic + 1 / clean).alias("error"))
        .filter(F.abs("score") >= settings.min_z * F.col("error"))
    )
    rows = kept.orderBy(F.abs("score").desc(), "kind", "token").limit(settings.vocabulary).collect()
    cap = settings.max_score

    def table(kind: str) -> dict[str, float]:
        return {r["token"]: max(-cap, min(cap, r["score"])) - settings.shift for r in rows if r["kind"] == kind}

    return ToxicityModel(table("w"), table("s"), -settings.shift, settings.stem_length)


def segments(docs: DataFrame, model: ToxicityModel, names: tuple[str, ...] = ("n_tokens", "best", "spans")) -> DataFrame:
    """The rows with two or three more columns: number of tokens, best segment score and, if named, all
    maximal segments as (first token, end, score).  Every text passes the task once."""
    size, best, *spans = names
    span = pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])
    schema = StructType([*docs.schema.fields, *StructType.fromDDL(f"`{size}` long, `{best}` double" + (
        f", `{spans[0]}` array<struct<begin:int,end:int,score:double>>" if spans else "")).fields])
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts, tops, strong = [], [], []
            for text in batch.column(place):
                words = tokens(text.as_py() or "")
                found = maximal_segments(score_tokens(words, model))
                counts.append(len(words))
                tops.append(max((s for *_, s in found), default=0.0))
                if spans:
                    strong.append([{"begin": b, "end": e, "score": s} for b, e, s in found if s > 1.0])
            more = [pa.array(counts, pa.int64()), pa.array(tops, pa.float64()), *([pa.array(strong, pa.list_(span))] if spans else [])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *names])

    return docs.mapInArrow(run, schema)


def _label_of(labels: DataFrame) -> DataFrame:
    return labels.filter("doc_id is not null and toxic is not null").groupBy(
        F.col("doc_id").cast("long").alias("label_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))


@dataclass(frozen=True)
class ToxicityFit:
    """A fitted model: token scores, and per class the location, its growth with ln n, and the scale."""

    tokens: ToxicityModel
    prior: float
    classes: tuple[tuple[float, float, float], ...]
    max_expected: float

    def score(self, size: Column, best: Column) -> tuple[Column, Column]:
        """Probability of the toxic class, and the score from which a segment is significant."""
        if len(self.classes) < 2:
            return F.lit(self.prior), F.lit(0.0)
        (a0, b0, s0), (a1, b1, s1) = self.classes
        gamma, grown = 0.5772156649015329, F.log1p(size)
        z0 = (best - (F.lit(a0) + b0 * grown)) / s0 + gamma
        z1 = (best - (F.lit(a1) + b1 * grown)) / s1 + gamma
        # Log densities of the two distributions; exponents are bounded so that they stay finite.
        log0 = -z0 - F.exp(F.least(F.lit(50.0), -z0)) - math.log(s0)
        log1 = -z1 - F.exp(F.least(F.lit(50.0), -z1)) - math.log(s1)
        odds = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), log1 - log0 + math.log(self.prior / (1 - self.prior))))
        return 1 / (1 + F.exp(-odds)), F.lit(a0) + b0 * grown - s0 * (math.log(self.max_expected) + gamma)


def fit(docs: DataFrame, labels: DataFrame, train: Column | None = None,
        settings: ToxicitySettings = ToxicitySettings()) -> ToxicityFit:
    """Fit on the labelled documents; ``train`` says which labels may be used."""
    chosen = _label_of(labels.filter(train) if train is not None else labels)
    # Bounded by fit_rows (some hundred kB), so it is broadcast and no text is shuffled.
    known = F.broadcast(cut_lineage(chosen.orderBy(F.xxhash64("label_id"), "label_id").limit(settings.fit_rows)))
    # One text per labelled id, so that rows which share an id don't grow the sample.
    labelled = cut_lineage(
        docs.select(F.col("doc_id").cast("long").alias("label_id"), "text").join(known, "label_id")
        .groupBy("label_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")))
    model = fit_tokens(labelled, settings)
    size = F.log1p("n_tokens")
    found = {
        r["toxic"]: r for r in segments(labelled, model, ("n_tokens", "best")).groupBy("toxic").agg(
            F.count("*").alias("n"), F.avg("best").alias("mean"), F.coalesce(F.stddev("best"), F.lit(0.0)).alias("sd"),
            F.var_pop("best").alias("var"), F.var_pop(size).alias("var_size"), F.covar_pop(F.col("best"), size).alias("cov"), F.avg(size).alias("size"),
        ).collect()
    }
    total = sum(r["n"] for r in found.values())
    prior = found[1]["n"] / total if 1 in found else 0.0
    classes = []
    for kind in (0, 1) if len(found) == 2 else ():
        r = found[kind]
        grows = r["var_size"] > 0 and r["var"] > 0 and r["cov"] > 0
        slope = r["cov"] / r["var_size"] if grows else 0.0
        left = r["sd"] * math.sqrt(max(0.0, 1 - r["cov"] ** 2 / (r["var"] * r["var_size"]))) if grows else r["sd"]
        classes.append((r["mean"] - slope * r["size"], slope, max(0.2, left * math.sqrt(6) / math.pi)))
    if classes:  # the toxic class is never the narrower one, so a higher score is never less likely toxic
        classes[1] = (*classes[1][:2], max(classes[0][2], classes[1][2]))
    return ToxicityFit(model, prior, tuple(classes), settings.max_expected)


def score_documents(docs: DataFrame, labels: DataFrame, train: Column | None = None,
                    settings: ToxicitySettings = ToxicitySettings(), threshold: float = 0.3) -> DataFrame:
    """``doc_id, score, predicted, n_tokens, passages``: the significant segments as (first token, end, score)."""
    fitted = fit(docs, labels, train, settings)
    score, significant = fitted.score(F.col("n_tokens"), F.col("best"))
    found = segments(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fitted.tokens)
    passages = F.filter("spans", lambda s: s["score"] >= F.col("significant"))
    return found.withColumn("score", score).withColumn("significant", significant).select(
        "doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_tokens", passages.alias("passages"))


def clean_documents(docs: DataFrame, labels: DataFrame, settings: ToxicitySettings = ToxicitySettings(),
                    threshold: float = 0.3) -> DataFrame:
    """The documents that aren't predicted toxic, with their columns; no join, no shuffle of texts.

    They are written once, a small batch of whole rows at a time.
    """
    fitted = fit(docs, labels, None, settings)
    names = tuple(fresh(docs, f"toxicity_{c}") for c in ("tokens", "best"))
    score, _ = fitted.score(F.col(names[0]), F.col(names[1]))
    with small_batches(docs.sparkSession):
        return cut_lineage(segments(docs, fitted.tokens, names).filter(score < threshold).select(*docs.columns))
