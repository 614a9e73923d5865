"""Toxicity by class-conditional Kneser-Ney models.

Two models, of toxic and of ordinary text, are interpolated from three orders:

    P(w | v, class) = max(n(v, w) - D2, 0) / n(v, .) + g(v) P(w | class)
    P(w | class)    = max(n(w) - D1, 0) / n(.)       + g    P(w)
    P(w)            = max(m(w) - D0, 0) / m(.)       + g0 / (words + 1)

n counts in the texts of a class, m in those of both: the lowest order is
shared, so a rare expression falls back to the same probability in both.  As
Kneser-Ney smoothing asks, counts are of distinct contexts, not of uses: of a
pair the words found before it, of a word the documents it is found in.  So
neither repetition in a text nor copies of a text make evidence of a pair.
Each g is the mass that the discounts take, so each distribution sums to 1 over
all words and the unknown one; discounts over 1 (a context or two are no
evidence) work alike.

Toxic text is mostly ordinary text: its model
draws one word in 1 / RATE from the toxic distribution and the others from the
ordinary one, so that a word's log-likelihood ratio r adds
log(1 - RATE + RATE exp(r)) to the difference of the log-likelihoods.  A text's score is that difference, normalised by length
(and, as a second feature, by its square root), on a logistic curve fitted on
labelled documents that the counts have not seen.

Bounds: at most about ``rows`` labelled documents are sampled (by hash, so the
same ones each time).  The model holds all of their words, and the pairs and
contexts over the discount; those under it change no ratio.

Defined cases: null and empty texts score as texts without evidence; rows
whose label or identifier is null are not learnt from; repeated label rows
count once; with one class only, or none, every score is the share of toxic
labels (0 without labels); extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.textkit import Block, blocks, bounded_batches, map_batches, mix, text_of
from tessera.storage import materialise

ROWS = 16_000
#: Discounts, in contexts: of pairs, of words in a class, of words in the shared order.
PAIR_DISCOUNT, WORD_DISCOUNT, SHARED_DISCOUNT = 8.0, 1.5, 0.75
#: Part of a toxic text's words that are drawn from the toxic distribution.
RATE = 0.001
#: Every fourth sampled document fits the curve, the others the counts.
CURVE_PART = 4
#: Stands before the first word of a text.
START = np.uint64(1)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_EDGE = np.zeros(256, bool)
_EDGE[[ord(c) for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"]] = True


def _words(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hash of each word and of the one before it, and the n+1 limits of the texts.

    Words are lower-cased, without punctuation at their ends.
    """
    data = _LOWER[block.data]
    if len(data) > 1:  # capitals of Latin-1 are C3 80 to C3 9E
        wide = (block.data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        data[1:][wide] += 0x20
    low = Block(block.first, data, block.bounds)
    starts, ends, limits = low.spans()
    for _ in range(3):
        ends = ends - (_EDGE[data[ends - 1]] & (ends - starts > 1)) if len(ends) else ends
    if len(starts):
        starts = starts + (_EDGE[data[starts]] & (ends - starts > 1))
    words = low.span_hashes(starts, ends)
    before = np.concatenate([[START], words[:-1]]) if len(words) else words
    before[limits[:-1][np.diff(limits) > 0]] = START
    return words, before, limits


def _pair(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    return mix(before * np.uint64(0x9FB21C651E98DF25) + words)


@dataclass
class Part:
    """Values by hash, ascending; others have none."""

    keys: np.ndarray
    values: np.ndarray

    def of(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which are known, and the values (0 for the others)."""
        if not len(self.keys):
            return np.zeros(len(hashes), bool), np.zeros(len(hashes))
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        known = self.keys[at] == hashes
        return known, np.where(known, self.values[at], 0.0)


def _part(keys: np.ndarray, values: np.ndarray) -> Part:
    order = np.argsort(keys)
    return Part(keys[order], values[order])


@dataclass
class Model:
    """Log-likelihood ratios of words and pairs, the log ratios of contexts' backoff weights, that of unknown words, and the curve.

    A pair's ratio stands for itself; any other word's is its own and that of
    the weights of the word before it.
    """

    words: Part
    contexts: Part
    pairs: Part
    unknown: float
    curve: tuple[float, ...]

    def ratios(self, words: np.ndarray, before: np.ndarray) -> np.ndarray:
        known, own = self.pairs.of(_pair(before, words))
        seen, alone = self.words.of(words)
        return np.where(known, own, np.where(seen, alone, self.unknown) + self.contexts.of(before)[1])

    def features(self, texts: pa.Array) -> np.ndarray:
        """For each text the difference of the log-likelihoods over its length and over the length's root."""
        out = []
        for block in blocks(texts):
            words, before, limits = _words(block)
            gain = np.log1p(RATE * np.expm1(np.minimum(self.ratios(words, before), 50.0)))
            total = np.bincount(text_of(limits), weights=gain, minlength=block.n)
            length = np.maximum(np.diff(limits), 1)
            out.append(np.stack([total / length, total / np.sqrt(length)], axis=1))
        return np.concatenate(out) if out else np.empty((0, 2))

    def score(self, texts: pa.Array) -> np.ndarray:
        bias, *weights = self.curve
        return 1 / (1 + np.exp(-np.clip(bias + self.features(texts) @ np.array(weights), -500, 500)))


def _fit_curve(x: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, ...]:
    """Logistic regression on standardised features by Newton's method, with a little shrinkage of the slopes."""
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return (math.log(max(share, 1e-9) / max(1 - share, 1e-9)), 0.0, 0.0)
    mean, spread = x.mean(axis=0), x.std(axis=0)
    spread[spread == 0] = 1
    design = np.column_stack([np.ones(len(x)), (x - mean) / spread])
    w, ridge = np.zeros(3), np.diag([0.0, 1e-3, 1e-3])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + ridge + 1e-9 * np.eye(3), design.T @ (y - p) - ridge @ w)
        w = w + np.clip(step, -20, 20)
        if np.abs(step).max() < 1e-8:
            break
    slopes = w[1:] / spread
    return (float(w[0] - slopes @ mean), *(float(v) for v in slopes))


def class_probabilities(counts: np.ndarray, own_total: float, own_taken: float, shared: np.ndarray) -> np.ndarray:
    """P(w | class) of words with ``counts`` documents; ``own_taken`` is the sum of what the discount takes from all counts."""
    return np.maximum(counts - WORD_DISCOUNT, 0) / own_total + own_taken / own_total * shared


def shared_probabilities(both: np.ndarray, total: float, taken: float, words: int) -> np.ndarray:
    """P(w) of words with ``both`` documents; that of the unknown word is that of 0."""
    return np.maximum(both - SHARED_DISCOUNT, 0) / total + taken / total / (words + 1)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _parts(counts: DataFrame) -> tuple[Part, Part, Part, float]:
    """The parts of a model from the contexts (t toxic, o ordinary, b of both) of each word (v = 0) and pair (v, w).

    What reaches the driver is at most what the sampled documents hold: their
    words, and pairs over the discount with their contexts.
    """
    empty = Part(np.empty(0, np.uint64), np.empty(0))
    taken = lambda c, discount: F.coalesce(F.sum(F.least(F.col(c), F.lit(discount))), F.lit(0.0))
    words = counts.where("v = 0")
    sums = words.agg(F.sum("t"), F.sum("o"), F.sum("b"), taken("t", WORD_DISCOUNT), taken("o", WORD_DISCOUNT), taken("b", SHARED_DISCOUNT), F.count("*")).head()
    totals, lost = (sums[0] or 0.0, sums[1] or 0.0), (sums[3], sums[4])
    if not all(totals):
        return empty, empty, empty, 0.0
    number = lambda table, c: table[c].to_numpy().view(np.uint64)
    known = words.toArrow()
    keys, t, o, b = number(known, "w"), known["t"].to_numpy(), known["o"].to_numpy(), known["b"].to_numpy()
    order = np.argsort(keys)
    keys, t, o, b = keys[order], t[order], o[order], b[order]
    shared = shared_probabilities(b, sums[2], sums[5], sums[6])
    toxic, ordinary = (class_probabilities(c, n, g, shared) for c, n, g in zip((t, o), totals, lost, strict=True))
    own, unknown = Part(keys, np.log(toxic / ordinary)), float(np.log(lost[0] / totals[0]) - np.log(lost[1] / totals[1]))
    pairs = counts.where("v <> 0")
    contexts = pairs.groupBy("v").agg(F.sum("t").alias("t"), F.sum("o").alias("o"), taken("t", PAIR_DISCOUNT).alias("lt"), taken("o", PAIR_DISCOUNT).alias("lo"), F.max(F.greatest("t", "o")).alias("most"))
    weights = contexts.where(F.col("most") > PAIR_DISCOUNT).toArrow()
    before = number(weights, "v")
    order = np.argsort(before)
    before = before[order]
    n, g = [], []
    for c in ("t", "o"):
        total, gone = weights[c].to_numpy()[order], weights["l" + c].to_numpy()[order]
        n.append(np.where(total > 0, total, 1.0))
        g.append(np.where(total > 0, gone / n[-1], 1.0))
    found = pairs.where(F.greatest("t", "o") > PAIR_DISCOUNT).toArrow()
    v, w = number(found, "v"), number(found, "w")
    if not len(v):
        return own, empty, empty, unknown
    at, i = np.searchsorted(before, v), np.searchsorted(keys, w)
    high = [np.maximum(found[c].to_numpy() - PAIR_DISCOUNT, 0) / n[k][at] + g[k][at] * p[i] for k, (c, p) in enumerate((("t", toxic), ("o", ordinary)))]
    return own, Part(before, np.log(g[0] / g[1])), _part(_pair(v, w), np.log(high[0] / high[1])), unknown


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = ROWS) -> Model:
    """The model of the labelled documents; ``labels`` (doc_id, label) holds only rows that may be learnt from."""
    bounded_batches(docs.sparkSession)
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
    known = known.groupBy(F.col(doc_id).alias("id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    total = known.count()
    # by hash, about ``rows`` of them: a sample of proven size, small enough to broadcast
    scale = 1 << 20
    share = min(scale, math.ceil(rows / max(total, 1) * scale))
    draw = F.pmod(F.xxhash64("id", F.lit(17)), F.lit(scale))
    picked = known.where(draw < share).withColumn("fits", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(CURVE_PART)) == 0)
    sample = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text")).join(F.broadcast(picked), "id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column(1).to_numpy(zero_copy_only=False)
            # (before, word, context): a word (0 before it) in a document, a pair behind a word
            found, marks = [np.empty((0, 3), np.uint64)], [np.empty(0, y.dtype)]
            for block in blocks(batch.column(0)):
                words, before, limits = _words(block)
                earlier = np.concatenate([[START], before[:-1]]) if len(before) else before
                earlier[before == START] = START
                owner = text_of(limits)
                place = (np.uint64(block.first) + owner.astype(np.uint64)) * np.uint64(2) + np.uint64(1)
                found += [np.stack([np.zeros_like(words), words, place], axis=1), np.stack([before, words, earlier], axis=1)]
                marks += [y[block.first + owner]] * 2
            every, mark = np.concatenate(found), np.concatenate(marks)
            name = _pair(_pair(every[:, 0], every[:, 1]), every[:, 2])
            _, first = np.unique(name * np.uint64(2) + mark.astype(np.uint64), return_index=True)
            every, mark = every[first], mark[first]
            alone = every[:, 0] == 0
            # documents of one batch are told apart from those of others by being counted here
            _, at, where = np.unique(every[alone, 1], return_index=True, return_inverse=True)
            t = np.bincount(where, weights=mark[alone], minlength=len(at))
            o = np.bincount(where, minlength=len(at)) - t
            rows = np.concatenate([every[alone][at] * np.array([1, 1, 0], np.uint64), every[~alone]]).view(np.int64)
            t, o = np.concatenate([t, mark[~alone] == 1]), np.concatenate([o, mark[~alone] == 0])
            yield pa.RecordBatch.from_arrays([*(pa.array(rows[:, k]) for k in range(3)), pa.array(t, pa.float64()), pa.array(o, pa.float64())], ["v", "w", "u", "t", "o"])

    found = map_batches(sample.where("not fits").select("text", "y"), count, "v long, w long, u long, t double, o double")
    words = found.where("v = 0").groupBy("v", "w").agg(F.sum("t").alias("t"), F.sum("o").alias("o")).withColumn("b", F.col("t") + F.col("o"))
    once = found.where("v <> 0").groupBy("v", "w", "u").agg(F.max("t").alias("t"), F.max("o").alias("o"))
    pairs = once.groupBy("v", "w").agg(F.sum("t").alias("t"), F.sum("o").alias("o"), F.count("*").cast("double").alias("b"))
    *parts, unknown = _parts(materialise(words.unionByName(pairs), "expressions"))
    model = Model(*parts, unknown, (0.0, 0.0, 0.0))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = model.features(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), batch.column(1)], ["a", "b", "y"])

    fit = map_batches(sample.where("fits").select("text", "y"), measure, "a double, b double, y int").toArrow()
    model.curve = _fit_curve(np.column_stack([fit["a"].to_numpy(), fit["b"].to_numpy()]), fit["y"].to_numpy().astype(float))
    return model


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns and the score (0 to 1) of every whole text."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + [pa.array(model.score(batch.column(len(keep))), pa.float64())], [*keep, "score"])

    chosen = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    return map_batches(chosen, run, f"{schema}, score double")


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents, learnt from the labels outside the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where(~held_out(F.col("doc_id")))
    scored = score(docs, train(docs, labels), ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
