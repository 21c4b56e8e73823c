"""Toxic passages by maximum-scoring segments of token log-odds.

Training: token and prefix counts of a bounded sample of labelled documents give log-odds with informative Dirichlet
priors; words without evidence take their prefix's score; other documents of the sample fit the extreme-value law and the
calibration. Scoring: one linear scan over a text's token scores finds every maximal segment; within a segment a word counts REPEATS times, so one with more of it is divided into its best
disjoint parts under that rule, each judged on its own; segments are significant by their extreme-value expectation; a document's score is a
logistic function of what its segments add up to.

Contract: a null or empty text has no segments and gets the lowest score; labels that are null or whose doc_id is
null teach nothing, and a doc_id labelled more than once counts as toxic if any row says so; repeated documents
are scored row by row; without labelled rows of both kinds every text gets score 0; only doc_id and text of the
documents are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import best_disjoint, crc32_fold, cut, scratch, ship, table

#: At most about this many labelled documents of each kind teach the model (chosen by a hash of doc_id).
SAMPLE_PER_LABEL = 6000
#: Sample documents that a word or prefix must be in. What the model holds is bounded by the sample.
MIN_DOCS = 3
PRIOR = 1.0  # Dirichlet pseudo-tokens for each vocabulary entry
SURE = 2.0  # standard errors taken off positive log-odds; with PRIOR the least log-loss in cross-validation (README)
DROP = 0.35  # cost of a token without evidence
REPEATS = 2  # further occurrences of a word in a segment are no evidence
TOXIC = 0.7
PREFIXES = (5, 4, 3)
_WORD = re.compile(r"[^\W_]+")


def tokens(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def _levels(word: str) -> list[str]:
    """A word and its prefixes, which are marked so that they differ from words."""
    return [word, *(f"^{word[:n]}" for n in PREFIXES if len(word) >= n)]


@dataclass
class Model:
    """Scores of known words and prefixes, the extreme-value constants and the logistic calibration."""

    scores: dict[str, float]
    decay: float = 1.0
    weight: float = 0.1
    a: float = -6.0
    b: float = 1.0

    def word(self, word: str) -> float:
        for level in _levels(word):
            found = self.scores.get(level)
            if found is not None:
                return found
        return -DROP


class _Cache(dict):
    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) > 100_000:
            self.clear()
        found = self[word] = self.model.word(word)
        return found


def evidence(words: list[str]) -> Counter:
    """Occurrences of a text's words and their prefixes; a word counts REPEATS times at most, as it does in a segment."""
    out: Counter = Counter()
    for word, n in Counter(words).items():
        for level in _levels(word):
            out[level] += min(n, REPEATS)
    return out


def _kind(token: str) -> int:
    """0 for words, the length for prefixes: each kind is a vocabulary of its own."""
    return len(token) if token[0] == "^" else 0


def log_odds(counts: dict[str, tuple[int, int]], prior: float = PRIOR, sure: float = SURE) -> dict[str, float]:
    """Score of each word and prefix from its occurrences in toxic and in clean documents.

    Both labels' token distributions have the same informative Dirichlet prior: prior pseudo-tokens for each vocabulary
    entry on average, half of them in proportion to the token's occurrences under both labels, half spread evenly.
    Positive log-odds count less ``sure`` standard errors, so that chance findings among rare words stay under zero. A
    word without clear evidence of its own is left out: its prefix, which has more, speaks for it.
    """
    sizes, toxic, clean = Counter(), Counter(), Counter()
    for token, (t, c) in counts.items():
        kind = _kind(token)
        sizes[kind] += 1
        toxic[kind] += t
        clean[kind] += c
    scores: dict[str, float] = {}
    for token, (t, c) in counts.items():
        kind = _kind(token)
        mass = prior * sizes[kind]
        alpha = mass / 2 * ((t + c) / (toxic[kind] + clean[kind]) + 1 / sizes[kind])
        at, ac = t + alpha, c + alpha
        odds = math.log(at / (toxic[kind] + mass)) - math.log(ac / (clean[kind] + mass))
        likely = odds - sure * math.sqrt(1 / at + 1 / ac)
        if likely > 1.0:
            scores[token] = min(8.0, likely)
        elif token[0] == "^" or c >= 2:
            scores[token] = min(-DROP, max(-2.0, odds))
    return scores


def segments(values: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, sum), disjoint, in linear time.

    Only tokens with positive scores start or end one, so the scan goes over runs of those and keeps for
    each open segment the cumulated sums before (left) and after it (right); a stack holds the segments whose
    left sum is under that of all later ones.
    """
    positive = np.flatnonzero(values > 0)
    if not len(positive):
        return []
    total = np.concatenate([[0.0], np.cumsum(values)])
    stack: list[list] = []  # [start, end, left, right]
    for i in positive.tolist():
        start, left, right = i, float(total[i]), float(total[i + 1])
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j -= 1
            if j < 0 or stack[j][3] >= right:
                stack.append([start, i + 1, left, right])
                break
            start, left = stack[j][0], stack[j][2]
            del stack[j:]
    return [(s, e, r - lo) for s, e, lo, r in stack]


def capped_segments(values: np.ndarray, words: list[str]) -> list[tuple[int, int, float]]:
    """Disjoint segments (start, end, sum) in which each word is evidence REPEATS times at most and costs DROP from then on.

    The cap only lowers sums, so the best segment under it has positive ends and lies within a maximal one. Those
    without further occurrences stay as they are; the others are divided into their best parts, highest sum first.
    """
    out = []
    positive = np.flatnonzero(values > 0)
    costs = np.concatenate([[0.0], np.cumsum(np.minimum(values, 0))])
    for start, end, total in segments(values):
        p = positive[np.searchsorted(positive, start) : np.searchsorted(positive, end)]
        # a word is evidence in parts that start after its occurrence REPEATS places back
        since, seen = np.full(len(p), -1, np.int64), defaultdict(list)
        for j, i in enumerate(p.tolist()):
            own = seen[words[i]]
            if len(own) >= REPEATS:
                since[j] = own[-REPEATS]
            own.append(i)
        if (since < 0).all():
            out.append((start, end, total))
            continue
        # sums from the start of a best part stay positive, which bounds its length by all evidence there can be
        most = int(REPEATS * (sum(float(values[own[0]]) for own in seen.values()) / DROP + len(seen))) + 1

        def best(first: int, limit: int, p=p, since=since, most=most) -> tuple[float, int]:
            a, b = np.searchsorted(p, (first, min(limit, first + most)))
            sums = np.cumsum(np.where(since[a:b] < first, values[p[a:b]], -DROP)) + costs[p[a:b]] - costs[first]
            k = int(sums.argmax())
            return float(sums[k]), int(p[a + k]) + 1

        out += sorted((s, e, v) for v, s, e in best_disjoint(best, p.tolist(), end))
    return out


def expectation(model: Model, best: float, n: int) -> float:
    """log10 of how many segments of this sum or more chance gives in a clean text of n tokens."""
    return (math.log(max(model.weight, 1e-9) * max(n, 1)) - model.decay * best) / math.log(10)


def _statistic(model: Model, found: list[tuple[int, int, float]], n: int) -> float:
    """Evidence of all significant segments: the sum of their -log10 expectations, slowly saturating."""
    parts = [max(0.0, -expectation(model, s, n)) for _, _, s in found]
    return math.log1p(sum(parts))


def score_text(model: Model, cache: dict, text: str | None) -> tuple[float, list[tuple[int, int, float]], list[str]]:
    words = tokens(text)
    values = np.fromiter(map(cache.__getitem__, words), np.float64, len(words))
    found = capped_segments(values, words)
    x = _statistic(model, found, len(words))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, model.a + model.b * x)))), found, words


def _decay(values: np.ndarray, counts: np.ndarray) -> float:
    """The positive root of sum p exp(decay x score) = 1 over clean tokens; it exists as the mean is negative."""
    p = counts / counts.sum()
    if not (values > 0).any() or float((p * values).sum()) >= 0:
        return 1.0
    low, high = 1e-6, 20.0
    for _ in range(80):
        middle = (low + high) / 2
        if float((p * np.exp(np.minimum(middle * values, 700))).sum()) > 1:
            high = middle
        else:
            low = middle
    return max(0.05, min(low, 3.0))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a, b of P(toxic) = 1 / (1 + exp(-(a + b x))) by Newton steps with a small ridge.

    Weights stand half-way between equal rows and equal classes.
    """
    w = np.where(y == 1, max(1, (y == 1).sum()) ** -0.5, max(1, (y == 0).sum()) ** -0.5)
    w = w / w.mean()
    z = np.stack([np.ones_like(x), x], 1)
    beta, ridge = np.zeros(2), 1e-3 * np.eye(2) * len(y)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        grad = z.T @ (w * (y - p)) - ridge @ beta
        step = np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + ridge + 1e-9 * np.eye(2), grad)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), max(float(beta[1]), 1e-3)


def training_ids(labels: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> DataFrame:
    """doc_id and toxic of the sample: rows whose hash is under a share that makes per_label rows of each kind."""
    clean = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    clean = clean.where((crc32_fold("doc_id", 3) != 1) & F.col("toxic").isin(0, 1))
    sizes = dict(clean.groupBy("toxic").count().collect())
    share = F.when(F.col("toxic") == 1, F.lit(per_label / max(1, sizes.get(1, 0)))).otherwise(F.lit(per_label / max(1, sizes.get(0, 0))))
    return clean.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000)


def train(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> Model:
    """Fits on labels outside the held-out third. The sample, and so the model, is bounded by per_label."""
    ship(docs.sparkSession)
    with scratch():
        return _train(docs, labels, per_label)


def _train(docs: DataFrame, labels: DataFrame, per_label: int) -> Model:
    chosen = training_ids(labels.select(F.col("doc_id").alias("_tox_id"), "toxic").withColumnRenamed("_tox_id", "doc_id"), per_label)
    # at most about 2 x per_label rows of two numbers: small enough to broadcast at any input size
    sample = cut(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("toxic", "text", (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(10)) < 3).alias("calibrates")), "tox-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits, held = (Counter(), Counter()), Counter()
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = evidence(tokens(text.as_py()))
                hits[label].update(found)
                held.update(found.keys())
        names = list(held)
        columns = [pa.array(names, pa.string()), *(pa.array([c[t] for t in names], pa.int64()) for c in (hits[1], hits[0], held))]
        yield pa.RecordBatch.from_arrays(columns, ["token", "toxic", "clean", "docs"])

    sums = sample.where(~F.col("calibrates")).mapInArrow(count, "token string, toxic long, clean long, docs long").groupBy("token").agg(*(F.sum(c).alias(c) for c in ("toxic", "clean", "docs")))
    kept = sums.where(F.col("docs") >= MIN_DOCS).select("token", "toxic", "clean").toPandas()  # bounded by the sample
    counts = {t: (int(a), int(b)) for t, a, b in kept.itertuples(index=False)}
    kinds = {r[0] for r in sample.where(~F.col("calibrates")).select("toxic").distinct().collect()}
    if len(kinds) < 2:
        return Model({}, a=-30.0)
    model = Model(log_odds(counts))
    levels = {t: c for t, (_, c) in counts.items() if t[0] != "^" and t in model.scores}
    # Words without a score cost DROP; their mass stands for the rest of the clean documents' words.
    known = np.array([model.scores[t] for t in levels]), np.array(list(levels.values()), float)
    model.decay = _decay(np.append(known[0], -DROP), np.append(known[1], max(1.0, known[1].sum())))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Cache(model)
        for batch in batches:
            rows = []
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                _, found, words = score_text(model, cache, text)
                rows.append((label, len(words), max((s for _, _, s in found), default=0.0), [s for _, _, s in found]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.float64())), strict=True)], ["label", "n", "best", "sums"])

    judged = sample.where("calibrates").mapInArrow(judge, "label long, n long, best double, sums array<double>").toPandas()
    # These documents took no part in the counts, so chance findings show here as they will elsewhere.
    return calibrated(model, judged["label"].to_numpy(int), judged["n"].to_numpy(int), list(judged["sums"]))


def calibrated(model: Model, labels: np.ndarray, sizes: np.ndarray, sums: list) -> Model:
    """The model with extreme-value constants and logistic weights from documents' labels, token counts and segment sums.

    Extreme values: in clean texts the mean number of segments of sum s or more is weight x n x exp(-decay s).
    """
    if not 0 < int(labels.sum()) < len(labels):
        return model
    level = 1.0
    above = np.concatenate([np.asarray(s, float) for s, y in zip(sums, labels, strict=True) if y == 0])
    above = above[above >= level]
    if len(above) >= 20:
        model.decay = max(0.05, min(model.decay, 1 / max(1e-3, float((above - level).mean()))))
    model.weight = max(1e-6, (len(above) + 0.5) / max(1.0, float(sizes[labels == 0].sum())) * math.exp(model.decay * level))
    x = np.array([_statistic(model, [(0, 0, v) for v in s], n) for s, n in zip(sums, sizes, strict=True)])
    model.a, model.b = _logistic(x, labels.astype(float))
    return model


def passages(docs: DataFrame, model: Model, significant: float = -2.0) -> DataFrame:
    """doc_id, score, and every significant passage: token positions, log10 expectation and the words."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Cache(model)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("log10_expected", pa.float64()), ("words", pa.string())]))
        for batch in batches:
            scores, spans = [], []
            for text in batch.column(1):
                score, found, words = score_text(model, cache, text.as_py())
                scores.append(score)
                spans.append([{"start": s, "end": e, "log10_expected": x, "words": " ".join(words[s:e])} for s, e, v in found if (x := expectation(model, v, len(words))) <= significant])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(spans, kind)], ["doc_id", "score", "passages"])

    schema = "doc_id long, score double, passages array<struct<start:int,end:int,log10_expected:double,words:string>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def reject_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The documents whose text scores under TOXIC, with all their columns."""
    ship(docs.sparkSession)
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Cache(model)
        for batch in batches:
            keep = [score_text(model, cache, t.as_py())[0] < TOXIC for t in batch.column(at)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op3_toxic_segments(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = passages(docs, model)
    return scored.select("doc_id", (crc32_fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"), F.size("passages").alias("passages"))
