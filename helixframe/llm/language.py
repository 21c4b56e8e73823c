"""Language identification as inference of a mixture.

Character n-grams of labelled documents give each language a distribution over hashed n-grams. A document's n-grams
are taken as drawn from a mixture of languages; expectation-maximisation finds the proportions, and languages leave
the set one by one while the penalised likelihood (BIC) gets better for it. The language with the largest share of
what is left is the prediction.

Contract: a null text, an empty one and one without letters are ``und`` with score 0; texts of one or two letters
have padded n-grams and are decided like all others; rows without lang teach nothing; without any labelled row all
are ``und``; ties go to the language that sorts first; repeated rows are predicted alike; only doc_id, text and
lang are read, lang only where it may teach.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_fold, cut, scratch, ship, table

#: Hash slots of n-grams; languages x slots bounds the model and what reaches the driver.
SLOTS = 1 << 16
#: At most about this many labelled documents of each language teach the model.
SAMPLE_PER_LANGUAGE = 4000
ORDERS = (3,)
STEPS = 8
TRACE = 0.05
SMOOTH = 0.5
#: n-grams of one text are weighed as this share of independent draws, since neighbours overlap.
INDEPENDENT = 1 / 3
#: Characters handled at once; a longer text goes through in blocks, each with the end of the one before.
BLOCK = 500_000

_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    """For each code point: 1 where it is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)), np.bool_, sys.maxunicode + 1)
    return _letters


def slots_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, slot, count) of all n-grams, sorted by text number and slot.

    Text is lower-cased; runs of other characters than letters become one space; n-grams need a letter.
    """
    if len(texts) == 1 and len(texts[0]) > BLOCK:
        return _long(texts[0])
    joined = " ".join(t.lower().replace("\0", " ") for t in texts)
    sizes = np.fromiter((len(t.lower()) for t in texts), np.int64, len(texts)) + 1
    points, is_letter = _points(joined)
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(points)]
    # one space between words and at both ends; texts are separated by one as well
    keep = is_letter | np.concatenate([[False], is_letter[:-1]])[: len(is_letter)]
    points, owner, is_letter = points[keep], owner[keep], is_letter[keep]
    if not len(points):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    end = [np.uint64(32)] * bool(is_letter[-1])
    points = np.concatenate([[np.uint64(32)], points, end]).astype(np.uint64)
    owner = np.concatenate([owner[:1], owner, owner[-1:][: len(end)]])
    letter = points != 32
    # owners of the letter at or after each place, and at or before it: n-grams over two texts are none
    after, before = np.where(letter, owner, np.append(owner[1:], -1)), np.where(letter, owner, np.append(-1, owner[:-1]))
    keys = []
    for n, (at, slot) in zip(ORDERS, _grams(points, letter), strict=True):
        own = after[at] == before[at + n - 1]
        keys.append(after[at[own]] * SLOTS + slot[own])
    key = np.concatenate(keys)
    key.sort()
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[at] // SLOTS, key[at] % SLOTS, np.diff(np.append(at, len(key)))


def _points(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points, with a space for each that is no letter, and which are letters."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    is_letter = _letter_table()[points]
    return np.where(is_letter, points, 32).astype(np.uint64), is_letter


def _grams(points: np.ndarray, is_letter: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Start and slot of each n-gram with a letter, for each order."""
    out = []
    for n in ORDERS:
        m = max(0, len(points) - n + 1)
        h = np.full(m, np.uint64(n * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        some = np.zeros(m, np.bool_)
        for k in range(n):
            h = (h ^ points[k : k + m]) * np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(32)
            some |= is_letter[k : k + m]
        out.append((np.flatnonzero(some), (h[some] & np.uint64(SLOTS - 1)).astype(np.int64)))
    return out


def _long(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """slots_of() of one long text, block by block: each order's n-grams go on from what it kept of the last block."""
    low = text.lower().replace("\0", " ")
    total = np.zeros(SLOTS, np.int64)
    held, was_letter = np.array([32], np.uint64), False
    for start in range(0, len(low), BLOCK):
        points, is_letter = _points(low[start : start + BLOCK])
        keep = is_letter | np.concatenate([[was_letter], is_letter[:-1]])
        was_letter = bool(is_letter[-1])
        end = [np.array([32], np.uint64)] if was_letter and start + BLOCK >= len(low) else []
        points = np.concatenate([held, points[keep], *end])
        letter = points != 32
        for n, (at, slot) in zip(ORDERS, _grams(points, letter), strict=True):
            fresh = at + n > len(held) if start else at >= 0  # the n-grams within what was held are counted already
            np.add.at(total, slot[fresh], 1)
        held = points[-(max(ORDERS) - 1) :]
    at = np.flatnonzero(total)
    return np.zeros(len(at), np.int64), at, total[at]


@dataclass
class Model:
    languages: list[str]
    rates: np.ndarray  # slots x languages, float32 probabilities


def train(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Fits on rows whose crc32(doc_id) mod 5 is not 0, at most about per_language of each language.

    The model holds SLOTS numbers for each language: it grows with the languages that lang names, not with the rows.
    """
    ship(docs.sparkSession)
    with scratch():
        return _train(docs, per_language)


def _train(docs: DataFrame, per_language: int) -> Model:
    usable = docs.select("doc_id", "lang", "text").where((crc32_fold("doc_id", 5) != 0) & F.col("lang").isNotNull())
    sizes = dict(usable.groupBy("lang").count().collect())
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((SLOTS, 0), np.float32))
    number = F.element_at(F.map_from_arrays(F.array(*map(F.lit, languages)), F.array(*map(F.lit, range(len(languages))))), F.col("lang"))
    share = F.element_at(F.array(*(F.lit(per_language / sizes[x]) for x in languages)), F.col("_lang") + 1)
    chosen = usable.withColumn("_lang", number).where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) < share * 1_000_000).select("_lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), SLOTS), np.int64)
        for batch in batches:
            lang = np.asarray(batch.column(0).to_pylist(), np.int64)
            for start, texts in _blocks(batch.column(1)):
                who, slot, n = slots_of(texts)
                np.add.at(total, (lang[start + who], slot), n)
        for k in range(len(languages)):
            at = np.flatnonzero(total[k])
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k)), pa.array(at), pa.array(total[k][at])], ["lang", "slot", "n"])

    sums = cut(chosen, "lang-sample").mapInArrow(count, "lang long, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    counts = np.full((SLOTS, len(languages)), 0.0)
    counts[sums["slot"].to_numpy(), sums["lang"].to_numpy()] = sums["n"].to_numpy()
    counts += SMOOTH
    return Model(languages, (counts / counts.sum(0)).astype(np.float32))


def _blocks(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Runs of neighbouring texts of about BLOCK characters (a longer text alone)."""
    start, held, size = 0, [], 0
    for k, text in enumerate(texts):
        t = text.as_py() or ""
        if held and size + len(t) > BLOCK:
            yield start, held
            start, held, size = k, [], 0
        held.append(t)
        size += len(t)
    if held:
        yield start, held


def _mix(p: np.ndarray, n: np.ndarray, starts: np.ndarray, owner: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood of all texts, each over its own languages (mask), by EM."""
    w = mask / mask.sum(1, keepdims=True)
    total = np.add.reduceat(n, starts)[:, None]
    for _ in range(STEPS):
        joint = p * w[owner]
        joint *= (n / joint.sum(1))[:, None]
        w = np.add.reduceat(joint, starts, axis=0) / total
        w = np.where(mask, np.maximum(w, 1e-6), 0.0)
        w /= w.sum(1, keepdims=True)
    loglik = np.add.reduceat(n * np.log((p * w[owner]).sum(1)), starts)
    return w, loglik


def infer(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(proportions, kept languages) of each text; rows of zeros where there is no letter."""
    k = len(model.languages)
    out, kept = np.zeros((len(texts), k)), np.zeros((len(texts), k), np.bool_)
    who, slot, n = slots_of(texts)
    if not len(who) or not k:
        return out, kept
    starts = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
    rows = who[starts]
    owner = np.repeat(np.arange(len(rows)), np.diff(np.append(starts, len(who))))
    p, n = model.rates[slot].astype(np.float64), n * INDEPENDENT
    draws = np.add.reduceat(n, starts)
    mask = np.ones((len(rows), k), np.bool_)
    w, loglik = _mix(p, n, starts, owner, mask)
    # Languages leave by their share, least first, as long as BIC improves; only texts that may gain run again.
    active, first = np.arange(len(rows)), True
    while len(active) and k > 1:
        many = mask[active].sum(1) > 1
        active = active[many]
        if not len(active):
            break
        smaller = mask[active].copy()
        least = np.where(smaller, w[active], np.inf).argmin(1)
        if first:  # all languages with next to nothing leave at once, and return together if that was wrong
            smaller &= (w[active] >= TRACE) | (w[active] == w[active].max(1, keepdims=True))
        smaller[np.arange(len(active)), np.where(smaller.sum(1) == mask[active].sum(1), least, w[active].argmin(1))] = False
        place = np.full(len(rows), -1)
        place[active] = np.arange(len(active))
        part = place[owner] >= 0
        sub_owner = place[owner[part]]
        sub_starts = np.flatnonzero(np.concatenate([[True], sub_owner[1:] != sub_owner[:-1]]))
        w2, l2 = _mix(p[part], n[part], sub_starts, sub_owner, smaller)
        fewer = mask[active].sum(1) - smaller.sum(1)
        better = l2 + 0.5 * fewer * np.log(np.maximum(draws[active], 2)) >= loglik[active]
        chosen = active[better]
        mask[chosen], w[chosen], loglik[chosen] = smaller[better], w2[better], l2[better]
        # after the first round those that keep all go on one by one; later ones are done
        active, first = (active if first else chosen), False
    out[rows], kept[rows] = np.where(mask, w, 0.0), mask
    return out, kept


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (its share) and the proportions of the languages that were kept."""
    ship(docs.sparkSession)
    names = model.languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
        for batch in batches:
            pred, score, mixed = [], [], []
            for _, texts in _blocks(batch.column(1)):
                w, kept = infer(model, texts)
                for row, keep in zip(w, kept, strict=True):
                    if not keep.any():
                        pred.append("und")
                        score.append(0.0)
                        mixed.append([])
                        continue
                    best = int(row.argmax())
                    pred.append(names[best])
                    score.append(float(min(1.0, row[best])))
                    mixed.append([{"lang": names[i], "share": float(row[i])} for i in np.flatnonzero(keep)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(mixed, kind)], ["doc_id", "lang_pred", "score", "languages"])

    schema = "doc_id long, lang_pred string, score double, languages array<struct<lang:string,share:double>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def op7_language_mixture(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, train(docs))
    return found.select("doc_id", (crc32_fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "languages")
