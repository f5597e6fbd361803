"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on ordinary text, and one on toxic text, which holds what toxic documents
say and ordinary ones don't. A text is cut into windows of a few words; a window that the toxic dictionary makes
shorter than the ordinary one does speaks for toxicity. The windows that speak most for it are turned into a probability.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaymill.llm.common import pick, rows_of, table
from assaymill.llm.language import learnable, letters

#: Labelled documents that are learned from, and characters of each: the only bounds of the sample.
TOXIC_DOCS, ORDINARY_DOCS, CHARS = 1536, 3072, 8000
#: Bytes of a window, cut between words; of a sequence that dictionaries are trained by; of the ordinary dictionary.
WINDOW, GRAM, ORDINARY = 16, 5, 2048
#: A sequence of bytes is toxic if so many toxic documents have it, so much more often than ordinary ones do, and if
#: chance would give that to none of a million sequences.
LEAST_DOCS, LEAST_RATIO, LEAST_EVIDENCE = 3, 5.0, 16.0
#: What every window begins with and every dictionary ends with: a match that is always found, so that the next costs only itself.
ANCHOR = b"\n=<#anchor#>=\n"
LEVEL = 9
TOP = 3
THRESHOLD = 0.7


def grams(word: bytes) -> list[bytes]:
    padded = b" " + word + b" "
    return [padded[i : i + GRAM] for i in range(len(padded) - GRAM + 1)]


def documents_with(texts: Iterable[bytes]) -> Counter:
    """Of each sequence of GRAM bytes in a word, how many texts have it."""
    counts: Counter = Counter()
    for text in texts:
        counts.update({g for word in set(text.split()) for g in grams(word)})
    return counts


def train(toxic: Sequence[bytes], ordinary: Sequence[bytes]) -> tuple[bytes, bytes]:
    """The toxic dictionary and the ordinary one.

    The ordinary one has the words most ordinary texts have, commonest last. The toxic one has the stretches of words
    made of sequences that toxic texts have and ordinary ones lack: as in the cover algorithm, those of most texts come
    first, and a stretch is taken while it adds a sequence.
    """
    here, there = documents_with(toxic), documents_with(ordinary)
    marked = set()
    for gram, n in here.items():
        ratio = n / len(toxic) / ((there[gram] + 0.5) / (len(ordinary) + 1))
        if n >= LEAST_DOCS and ratio > LEAST_RATIO and n * math.log(ratio) >= LEAST_EVIDENCE:
            marked.add(gram)
    stretches: Counter = Counter()
    for text in toxic:
        for word in set(text.split()):
            at, flags = 0, [g in marked for g in grams(word)]
            while True in flags[at:]:
                start = flags.index(True, at)
                at = flags.index(False, start) if False in flags[start:] else len(flags)
                stretches[(b" " + word + b" ")[start : at - 1 + GRAM]] += 1
    chosen, covered = [], set()
    for stretch, _ in sorted(stretches.items(), key=lambda s: (-s[1], s[0])):
        own = {stretch[i : i + GRAM] for i in range(len(stretch) - GRAM + 1)}
        if own - covered:
            chosen.append(stretch)
            covered |= own
    words = Counter(w for text in ordinary for w in set(text.split()))
    common = b" ".join(w for w, _ in sorted(words.items(), key=lambda w: (w[1], w[0])))
    return b"".join(reversed(chosen)), common[-ORDINARY:]


def windows(text: bytes) -> Iterator[bytes]:
    """The whole text, in pieces of at most WINDOW bytes that end between words where they can."""
    at = 0
    while at < len(text):
        end = at + WINDOW
        if end < len(text):
            space = text.rfind(b" ", at, end)
            end = space + 1 if space > at else end
        yield ANCHOR + b" " + text[at:end]
        at = end


class Distances:
    """How much shorter windows get by toxic words: bytes with the ordinary dictionary less those with both."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.toxic = self.compressor(toxic + ANCHOR)
        self.ordinary = self.compressor(ordinary + ANCHOR)
        self.both = self.compressor(ordinary + toxic + ANCHOR)
        unknown = bytes(range(1, 9))
        self.overhead = len(self.toxic(ANCHOR + unknown)) - len(unknown) - len(ANCHOR)

    @staticmethod
    def compressor(content: bytes):
        import zstandard

        made = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, source_size=128, dict_size=len(content), min_match=GRAM, strategy=zstandard.STRATEGY_BTLAZY2,
            write_checksum=False, write_content_size=False, write_dict_id=False,
        )
        primed = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primed.precompute_compress(compression_params=made)
        return zstandard.ZstdCompressor(dict_data=primed, compression_params=made).compress

    def __call__(self, text: str | None) -> np.ndarray:
        """The TOP largest distances and the logarithm of the number of windows. A window that toxic words alone don't
        shorten has none."""
        found, n = [0] * TOP, 0
        for window in windows(letters(text).encode()):
            n += 1
            if len(self.toxic(window)) < len(window) + self.overhead:
                found.append(len(self.ordinary(window)) - len(self.both(window)))
        return np.array([*sorted(found, reverse=True)[:TOP], math.log1p(n)], float)


def logistic(features: np.ndarray, labels: np.ndarray, weights: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Coefficients and intercept of a weighted logistic regression, by Newton's method."""
    x = np.hstack([features, np.ones((len(features), 1))])
    penalty = np.diag([ridge] * features.shape[1] + [1e-6])
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weights * (p - labels)) + penalty @ beta
        curve = (x * (weights * p * (1 - p))[:, None]).T @ x + penalty
        step = np.linalg.solve(curve, slope)
        beta -= step
        if abs(step).max() < 1e-8:
            break
    return beta


@dataclass(frozen=True)
class Model:
    """Two dictionaries, and what turns distances into a probability."""

    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]

    def scorer(self):
        distances, weights = Distances(self.toxic, self.ordinary), np.array(self.weights)

        def score(text: str | None) -> float:
            found = distances(text)
            return float(1 / (1 + math.exp(-np.clip(found @ weights[:-1] + weights[-1], -30, 30))))

        return score


def sample(docs: DataFrame, labels: DataFrame, toxic_docs: int = TOXIC_DOCS, ordinary_docs: int = ORDINARY_DOCS, chars: int = CHARS) -> list:
    """(doc_id, toxic, of_class, piece): at most ``toxic_docs`` and ``ordinary_docs`` learnable labelled documents.

    Labelled identifiers are dealt to slots by hash, and of each slot the one of the lowest hash is taken; of its text
    ``chars`` characters, from a place that the hash gives. of_class is how many identifiers have that label. Null
    identifiers, labels and texts aren't learned from; any label of 1 counts; of rows of one identifier one is taken.
    """
    marks = pick(labels, doc_id="long", toxic="int").where("doc_id is not null and toxic is not null")
    marks = marks.where(learnable(F.col("doc_id"))).groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    hash_ = F.xxhash64("doc_id", F.lit("toxic"))
    slots = F.when(F.col("toxic") == 1, toxic_docs).otherwise(ordinary_docs)
    dealt = marks.select("toxic", F.pmod(hash_, slots).alias("slot"), F.struct(hash_.alias("h"), "doc_id").alias("of"))
    taken = dealt.groupBy("toxic", "slot").agg(F.min("of").alias("of"), F.count("*").alias("n")).collect()  # one a slot
    of_class = Counter()
    for r in taken:
        of_class[r["toxic"]] += r["n"]
    named = docs.sparkSession.createDataFrame([(r["of"]["doc_id"], r["of"]["h"], r["toxic"]) for r in taken], "doc_id long, h long, toxic int")
    length = F.length("text")
    start: Column = F.when(length > chars, F.pmod(F.shiftright("h", 8), length - chars)).otherwise(0)
    rows = pick(docs, doc_id="long", text="string").join(F.broadcast(named), "doc_id").where("text is not null")
    piece = F.struct(F.xxhash64("text").alias("x"), F.col("text").substr(start.cast("int") + 1, F.lit(chars)).alias("piece"))
    pieces = rows.groupBy("doc_id", "toxic").agg(F.min(piece).alias("of")).collect()  # one a slot, again
    return sorted((r["doc_id"], r["toxic"], of_class[r["toxic"]], r["of"]["piece"]) for r in pieces)


def learn(found: list) -> Model:
    """The model of a sample. Distances that the probability is fitted to come from dictionaries of the other half of
    the sample; classes weigh as much as all their rows. A sample without both labels gives a model that knows nothing."""
    labels = np.array([t for _, t, _, _ in found], int)
    if len(set(labels)) < 2:
        return Model(b" ", b" ", (*[0.0] * (TOP + 1), 3.0 if labels.sum() else -3.0))
    texts = [letters(piece).encode() for *_, piece in found]
    half = np.array([i % 2 for i in range(len(found))])
    half[np.argsort(labels, kind="stable")] = half.copy()  # both halves get as many of each label
    features = np.zeros((len(found), TOP + 1))
    for side in (0, 1):
        told = [[t for t, lab, h in zip(texts, labels, half, strict=True) if lab == k and h != side] for k in (1, 0)]
        distances = Distances(*train(*told))
        for i in np.flatnonzero(half == side):
            features[i] = distances(found[i][3])
    shares = np.array([n for _, _, n, _ in found], float)
    counts = np.bincount(labels)
    weights = shares / counts[labels]
    weights *= len(weights) / weights.sum()
    beta = logistic(features, labels, weights)
    return Model(*train(*[[t for t, lab in zip(texts, labels, strict=True) if lab == k] for k in (1, 0)]), tuple(map(float, beta)))


def score_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted (1 from ``threshold`` on) of every row of ``docs`` (doc_id, text).

    Whole texts are read, each on its own; the text alone bears on the score. Null, empty and letterless texts have no
    window and get the probability of a text without distances. Repeated rows are all scored, alike; an empty table gives no rows;
    other columns are ignored.
    """

    def judged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index("doc_id"))
            scores = [score(text) for (text,) in rows_of(batch, "text")]
            yield pa.RecordBatch.from_arrays([keys, pa.array(scores, pa.float64())], names=["doc_id", "score"])

    found = pick(docs, doc_id="long", text="string").mapInArrow(judged, "doc_id long, score double")
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op12_toxicity(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over all of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    model = learn(sample(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(~learnable(F.col("doc_id")), F.lit(False))
    return score_documents(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")
