"""Toxicity by maximum-scoring segments of token log-odds.

Tokens and their stems (first letters) get log-odds of the toxic against the
clean class under a Dirichlet prior (the prior's mean is the share in both
classes together), less a multiple of their standard error; a token scores the
best of its own and its stems' odds, and tokens without significant positive
odds share one negative score. A linear scan finds all maximal segments of a text's
token scores. Segment scores are calibrated by the extreme-value law of
maximal segments: among n clean tokens a score S or more is expected
K n exp(-lambda S) times. What the segments exceed that by is summed and turned
into a probability.

The odds are learned on a bounded sample of labelled rows; half of it gives
the odds whose segments calibrate the other half, so that the calibration sees
scores as unseen texts get them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.scratch import Scratch, hashed_sample

#: Labelled rows of each class learned from, at most (those with the smallest hash of the id).
SAMPLE_ROWS = 20_000
#: Tokens with positive scores, at most (those with the most significant odds).
VOCABULARY = 20_000
#: Weight of the prior as a part of the sample; standard errors taken off the odds; odds below which a token counts as any
#: other; toxic documents a token must be in.
PRIOR, ERRORS_OFF, LEAST_ODDS, LEAST_DOCS = 0.05, 1.5, 2.75, 3
#: Score of every other token.
BACKGROUND = -0.25

TOKEN = re.compile(r"[^\W_]+")
#: Letters of the stems of a token; a stem is written with a mark, so that it is no token.
STEMS, MARK = (3, 4, 5, 7), "~"
#: Tokens whose scores a worker remembers.
MEMO_TOKENS = 1_000_000
SEGMENTS = "array<struct<start:int,end:int,score:double>>"
SCORE_SCHEMA = f"doc_id long, score double, predicted int, excess double, segments {SEGMENTS}"


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def forms(token: str) -> list[str]:
    """The token and its stems."""
    return [token, *(token[:n] + MARK for n in STEMS if n < len(token))]


class TokenScores(dict):
    """Score of every token asked for so far, 0 for those without odds."""

    def __init__(self, odds: dict[str, float]):
        super().__init__()
        self.odds = odds

    def __missing__(self, token: str) -> float:
        if len(self) > MEMO_TOKENS:
            self.clear()
        self[token] = value = max((self.odds.get(f, 0.0) for f in forms(token)))
        return value


def maximal_segments(places: list[int], scores: list[float], between: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score) of a sequence that scores ``scores`` (positive) at ``places`` and
    ``between`` (negative) elsewhere; linear in the number of places.

    Candidates hold the running total before and after them, and which earlier
    candidate is the last with a smaller total before it.
    """
    found: list[tuple[float, float, int, int, int]] = []
    total, last = 0.0, -1
    for place, score in zip(places, scores, strict=True):
        before = total + between * (place - last - 1)
        total, last, first = before + score, place, place
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][0] >= before:
                j = found[j][4]
            if j < 0 or found[j][1] >= total:
                found.append((before, total, first, place, j))
                break
            before, first = found[j][0], found[j][2]
            del found[j:]
    return [(first, end, after - before) for before, after, first, end, _ in found]


@dataclass
class Model:
    """Token scores and calibration; a few hundred kB, bounded by VOCABULARY."""

    scores: dict[str, float] = field(default_factory=dict)
    background: float = BACKGROUND
    rate: float = 1.0
    density: float = 1.0
    offset: float = -2.0
    slope: float = 1.0

    def __post_init__(self) -> None:
        self.known = TokenScores(self.scores)

    def hits(self, words: list[str]) -> tuple[list[int], list[float]]:
        """Places and scores of the tokens with positive scores."""
        each = list(map(self.known.__getitem__, words))
        places = [i for i, s in enumerate(each) if s]
        return places, [each[i] for i in places]

    def segments(self, words: list[str]) -> list[tuple[int, int, float]]:
        return maximal_segments(*self.hits(words), self.background)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "known"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def excess(self, segments: list[tuple[int, int, float]], size: int) -> float:
        """Normalised scores above zero, summed; the best one where none is. On a logarithmic scale to either side of zero, so
        that a long text with many segments does not set the slope for all."""
        level = math.log(self.density * (size + 1))
        each = [self.rate * s - level for *_, s in segments]
        total = sum(e for e in each if e > 0) or max(each, default=-level)
        return math.copysign(math.log1p(abs(total)), total)

    def probability(self, excess: float) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.offset + self.slope * excess))))


def rate_of(shares: np.ndarray, scores: np.ndarray, background: float) -> float:
    """The positive root of E[exp(rate * score)] = 1 for tokens of clean texts."""
    rest = 1 - shares.sum()

    def above(rate: float) -> bool:
        return float((shares * np.exp(rate * scores)).sum()) + rest * math.exp(rate * background) > 1

    low, high = 0.0, 1.0
    while not above(high) and high < 64:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if above(middle) else (middle, high)
    return max(high, 1e-3)


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Offset and slope by Newton steps, with a little ridge so that separable classes stay finite."""
    scale = max(float(np.abs(x).max(initial=0.0)), 1.0)
    design, beta = np.stack((np.ones_like(x), x / scale), axis=1), np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (weight * (y - p)) - 1e-2 * beta
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1] / scale)


def _token_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with each token, by class and fold, combined per batch; a null token counts documents and tokens."""
    for batch in batches:
        counts: dict[tuple[int, int], Counter] = {(t, f): Counter() for t in (0, 1) for f in (0, 1)}
        size: Counter = Counter()
        for text, toxic, fold in zip(*(batch[c] for c in ("text", "toxic", "fold")), strict=True):
            words = tokens(text.as_py() or "")
            slot = (toxic.as_py(), fold.as_py())
            counts[slot].update({f for w in set(words) for f in forms(w)})
            size[slot] += 1
        rows = [(w, t, f, n) for (t, f), c in counts.items() for w, n in c.items()] + [(None, t, f, n) for (t, f), n in size.items()]
        columns = zip(*rows, strict=True) if rows else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["token", "toxic", "fold", "n"])


def token_scores(counts: DataFrame, sizes: dict[tuple[int, int], int], folds: tuple[int, ...], vocabulary: int) -> dict[str, float]:
    """Scores of the most significant tokens and stems by the counts of ``folds``."""
    n1, n0 = (sum(sizes.get((t, f), 0) for f in folds) for t in (1, 0))
    y1, y0 = (sum((F.col(f"y{t}{f}") for f in folds), F.lit(0)) for t in (1, 0))
    weight = PRIOR * max(1, n1 + n0)
    prior = PRIOR * (F.col("y1") + F.col("y0"))
    ones, zeros = F.col("y1") + prior + 1e-9, F.col("y0") + prior + 1e-9
    # documents with the token against documents without
    odds = F.log(ones / (n1 + weight - ones)) - F.log(zeros / (n0 + weight - zeros))
    scored = (
        counts.select("token", y1.alias("y1"), y0.alias("y0")).where(F.col("y1") >= LEAST_DOCS)
        .select("token", odds.alias("odds"), F.sqrt(1 / ones + 1 / zeros).alias("error"))
        .where(F.col("odds") - ERRORS_OFF * F.col("error") > LEAST_ODDS)
        .orderBy(F.desc(F.col("odds") / F.col("error")), "token").limit(vocabulary)
    )
    return {r.token: r.odds - ERRORS_OFF * r.error for r in scored.collect()}


def _statistics(models: dict[int, Model]):
    """Token scores, segment scores and size of labelled texts, each by the model of the other fold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, label, part in zip(*(batch[c] for c in ("text", "toxic", "fold")), strict=True):
                words = tokens(text.as_py() or "")
                places, scores = models[part.as_py()].hits(words)
                segments = maximal_segments(places, scores, BACKGROUND)
                rows.append((label.as_py(), len(words), scores, sorted((s for *_, s in segments), reverse=True)))
            types, names = (pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())), ["toxic", "size", "hits", "scores"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 4, types, strict=True)], names=names)

    return run


def held_out(doc_id: Column) -> Column:
    """Every fifth id by checksum; rows without an id are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, vocabulary: int = VOCABULARY) -> Model:
    """Model from the rows of ``docs`` (doc_id, text) that ``labels`` (doc_id, toxic) marks, those held out left aside.

    An id labelled more than once is toxic if any label says so; null labels
    and ids, and equal texts after the first, are left aside. Without rows of
    both classes the model knows no token and scores every text low.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    marked = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    marked = scratch.keep(marked, "marked")
    class_rows = dict(marked.groupBy("toxic").count().collect())
    one, other = (hashed_sample(marked.where(F.col("toxic") == t), ["_id"], sample_rows, class_rows.get(t, 0)) for t in (1, 0))
    sample = one.union(other)
    # at most 2 * sample_rows rows of two numbers
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_id"))
    texts = chosen.select("text", "toxic", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest")).dropDuplicates(["digest", "toxic"])
    texts = scratch.keep(texts.select("text", "toxic", F.pmod(F.xxhash64("digest"), F.lit(2)).cast("int").alias("fold")), "texts")
    counted = scratch.keep(texts.mapInArrow(_token_rows, "token string, toxic int, fold int, n long").groupBy("token").agg(*[
        F.sum(F.when((F.col("toxic") == t) & (F.col("fold") == f), F.col("n")).otherwise(0)).alias(f"y{t}{f}") for t in (0, 1) for f in (0, 1)
    ]), "counted")
    total = counted.where("token IS NULL").first()
    sizes = {(t, f): total[f"y{t}{f}"] for t in (0, 1) for f in (0, 1)} if total else {}
    counts = counted.where("token IS NOT NULL")
    if not sizes or not all(any(sizes[t, f] for f in (0, 1)) for t in (0, 1)):
        return Model()
    models: dict[int, Model] = {}
    for fold in (0, 1):  # the model of one half scores the other
        models[fold] = Model(token_scores(counts, sizes, (1 - fold,), vocabulary))
    model = Model(token_scores(counts, sizes, (0, 1), vocabulary))
    seen = texts.mapInArrow(_statistics(models), "toxic int, size long, hits array<double>, scores array<double>").collect()  # bounded by the sample
    clean = [r for r in seen if r.toxic == 0] or seen
    # one more hit than seen, at the best score, so that the rate stays finite
    hits = np.array([s for r in clean for s in r.hits] + [max(model.scores.values(), default=1.0)])
    model.rate = rate_of(np.full(len(hits), 1 / (2 + sum(r.size for r in clean))), hits, BACKGROUND)
    # maximum likelihood of the density, given the rate, from the best scores of clean texts
    model.density = len(clean) / max(1e-9, sum((r.size + 1) * math.exp(-model.rate * (r.scores[0] if r.scores else 0.0)) for r in clean))
    share = Counter(r.toxic for r in seen)
    x = np.array([model.excess([(0, 0, s) for s in r.scores], r.size) for r in seen])
    y = np.array([r.toxic for r in seen], float)
    weight = np.array([class_rows.get(r.toxic, 1) / share[r.toxic] for r in seen])
    model.offset, model.slope = fit_logistic(x, y, weight * len(seen) / weight.sum())
    return model


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Model = model.value
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text in batch["text"]:
                words = tokens(text.as_py() or "")
                segments = known.segments(words)
                excess = known.excess(segments, len(words))
                score = known.probability(excess)
                level = math.log(known.density * (len(words) + 1))
                strong = [{"start": a, "end": b + 1, "score": s} for a, b, s in segments if known.rate * s > level]
                for column, value in zip(out, (score, int(score >= 0.5), excess, strong), strict=True):
                    column.append(value)
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], *(pa.array(c, t) for c, t in zip(out, (pa.float64(), pa.int32(), pa.float64(), kind), strict=True))],
                names=["doc_id", "score", "predicted", "excess", "segments"],
            )

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1), predicted (score >= 0.5), excess, and the significant segments (in tokens), per row of ``docs``.

    Null and empty texts have no tokens and are scored as such. Repeated rows
    give repeated results; null ids are kept; other columns are ignored.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scored(known), SCORE_SCHEMA)


def _clean(model, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Model = model.value
        for batch in batches:
            keep = []
            for text in batch["text"]:
                words = tokens(text.as_py() or "")
                keep.append(known.probability(known.excess(known.segments(words), len(words))) < 0.5)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the rows predicted toxic; all columns stay."""
    known = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_clean(known, docs.columns), docs.schema)
