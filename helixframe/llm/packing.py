"""Best-fit packing with certified bin counts.

Documents become token ids, are cut into pieces of at most ``size`` ids and packed into sequences. Pieces are
dealt over groups by a hash; each group runs best-fit decreasing and compares its bins with a lower bound from
dual-feasible functions. Groups give the pieces of their loosest sequences away, by the gap to the bound; those are
dealt anew over fewer groups and packed again, until one group is left, which exchanges pieces among its own sequences.
Each row carries its group's bins and bound; certificate() gives both for the whole result.

Contract: a null text is empty and becomes one piece (id 1 alone); equal or repeated rows, null ids and equal
lengths are all packed, each row by itself; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import functools
import json
import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ship, table

SEQUENCE = 4096
#: Pieces in a group; one group is one task's work, so this bounds memory, not the result.
GROUP_PIECES = 4000
#: What groups give away is dealt anew over this many times fewer groups.
MERGE = 16
#: Reruns of the last group while it misses its bound.
LAST_TRIES = 400
TOKENIZER = "word_bpe_49k.json"
END = 1

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, uid long"

#: Text of these characters splits the same way under Python's re as under the tokenizer's own pattern.
_PLAIN = re.compile("[\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ]*")
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
#: Pre-tokens kept per Python worker; beyond it the store starts afresh (a matter of memory only).
_KEEP = 200_000
#: Stands for the end of a word in the byte form of the vocabulary; UTF-8 never holds this byte.
_WORD_END = b"\xff"


def _path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_of() -> dict[str, int]:
    """Characters of byte-level vocabularies to their bytes: printable bytes stand for themselves, others follow from 256 on."""
    plain = {b for a, z in ((33, 126), (161, 172), (174, 255)) for b in range(a, z + 1)}
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def _ranks(name: str) -> tuple[dict[bytes, int], dict, list] | None:
    """The vocabulary's byte strings to their ids, the vocabulary and its merges; None if ids don't go up with the merges."""
    with open(_path(name), encoding="utf-8") as file:
        model = json.load(file)["model"]
    if model.get("type") != "BPE" or model.get("end_of_word_suffix") != "</w>" or model.get("dropout") or model.get("ignore_merges"):
        return None
    vocab, merges = model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    made = [vocab.get(a + b, -1) for a, b in merges]
    first = made[0] if made else 0
    if any(b <= a for a, b in zip(made, made[1:], strict=False)) or first != len(vocab) - len(made) or sorted(vocab.values()) != list(range(len(vocab))):
        return None
    if any(len(t.removesuffix("</w>")) != 1 for t, i in vocab.items() if i < first):
        return None
    byte_of = _byte_of()
    try:
        ranks = {bytes(byte_of[c] for c in t.removesuffix("</w>")) + _WORD_END * t.endswith("</w>"): i for t, i in vocab.items() if t != "\u00ff"}
    except KeyError:
        return None
    return ranks | {_WORD_END: len(vocab)}, vocab, merges


@functools.cache
def _by_rank(name: str):
    """Byte-pair merging by rank alone: bytes of a pre-token and _WORD_END to its ids."""
    import tiktoken

    return tiktoken.Encoding(name, pat_str=r"\S+", mergeable_ranks=_ranks(name)[0], special_tokens={})._core_bpe.encode_single_piece


@functools.cache
def ranks_suffice(name: str = TOKENIZER) -> bool:
    """Whether merging by rank alone gives the tokenizer's ids for every pre-token.

    The tokenizer merges listed pairs, in their order; merging by rank joins any two neighbours whose union is in the
    vocabulary, in the order of ids. Both agree on all texts if the tokenizer encodes each entry of the vocabulary as itself:
    then, by induction over ranks, what stands for an entry before its own merge is the listed pair and no other.
    """
    from tokenizers.models import BPE

    found = _ranks(name)
    if found is None:
        return False
    _, vocab, merges = found
    inner, last = BPE(vocab=vocab, merges=merges), BPE(vocab=vocab, merges=merges, end_of_word_suffix="</w>")
    return all([x.id for x in (last if t.endswith("</w>") else inner).tokenize(t.removesuffix("</w>"))] == [i] for t, i in vocab.items())


class _Ids(dict):
    """Pre-token to its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, name: str, by_rank: bool):
        super().__init__()
        self.name, self.ranked = name, _by_rank(name) if by_rank else None

    @functools.cached_property
    def tokenizer(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_file(_path(self.name))

    def __missing__(self, token: str) -> bytes:
        if len(self) >= _KEEP:
            self.clear()
        ids = self.ranked(token.encode() + _WORD_END) if self.ranked else self.tokenizer.encode(token, add_special_tokens=False).ids
        found = self[token] = struct.pack(f"<{len(ids)}I", *ids)
        return found

    def of_text(self, text: str) -> bytes:
        tokens = _split(text)
        if tokens is None:
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.__getitem__, tokens))


_stores: dict[tuple[str, bool], _Ids] = {}


def _store(name: str, by_rank: bool) -> _Ids:
    store = _stores.get((name, by_rank))
    if store is None:
        store = _stores[name, by_rank] = _Ids(name, by_rank)
    return store


def _split(text: str) -> list[str] | None:
    """Pre-tokens of plain Latin text; None for other text and where a special token's string might stand."""
    return None if "<|" in text or not _PLAIN.fullmatch(text) else _SPLIT.findall(text.lower())


def ids_bytes(text: str | None, name: str = TOKENIZER) -> bytes:
    """A text's ids as little-endian unsigned 32-bit bytes, exactly those of the tokenizer.

    Plain Latin text goes pre-token by pre-token through a store of known ones; all other text, and text that
    might hold a special token's string, goes through the tokenizer as a whole.
    """
    return next(all_ids_bytes([text], name))


def all_ids_bytes(texts: Iterable[str | None], name: str = TOKENIZER) -> Iterator[bytes]:
    """ids_bytes() of each text."""
    store = _store(name, ranks_suffice(name))
    return (store.of_text(text or "") for text in texts)


def pieces(docs: DataFrame, size: int = SEQUENCE, tokenizer: str = TOKENIZER) -> DataFrame:
    """One row for each piece of each document; uid tells rows apart."""

    by_rank = ranks_suffice(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 40
        store = _store(tokenizer, by_rank)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = store.of_text(text.as_py() or "") + END.to_bytes(4, "little")
                n = len(data) // 4
                for piece, start in enumerate(range(0, n, size)):
                    part = data[4 * start : 4 * (start + size)]
                    rows.append((doc, piece, start, len(part) // 4, zlib.crc32(part), uid))
                    uid += 1
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "uid"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def lower_bound(lengths: np.ndarray, size: int) -> int:
    """Fewest bins of this size for these lengths, by dual-feasible functions.

    With f0(x) = x it is the volume bound. For each threshold t up to half a bin, u_t counts lengths over
    size - t as whole bins, keeps those from t on and drops those under t; and the staircase
    f_k(x) = floor((k+1) x / size) / k (x itself where (k+1) x is a multiple of size) weighs large pieces.
    All sums are exact integers.
    """
    return bound_of_counts(np.bincount(lengths, minlength=size + 1).astype(np.int64))


def bound_of_counts(n: np.ndarray) -> int:
    """lower_bound() of n[x] pieces of each length x."""
    size = len(n) - 1
    if not n.any():
        return 0
    x = np.arange(size + 1, dtype=np.int64)
    best = -(-int((n * x).sum()) // size)
    count, volume = np.cumsum(n), np.cumsum(n * x)
    t = np.arange(0, size // 2 + 1)
    over = count[size] - count[size - t]
    middle = volume[size - t] - np.where(t > 0, volume[np.maximum(t - 1, 0)], 0)
    best = max(best, int((over + -(-middle // size)).max()))
    for k in range(1, 33):
        y = (k + 1) * x
        weight = np.where(y % size == 0, x * k, (y // size) * size)
        best = max(best, -(-int((n * weight).sum()) // (k * size)))
    return best


def best_fit_decreasing(lengths: np.ndarray, size: int, in_order: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each length, and what each bin holds; longest first (or in the given order), into the fullest bin with room."""
    order = np.arange(len(lengths)) if in_order else np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    held: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    mask = 0  # bit r is set where a bin with room r exists
    for i in order.tolist():
        need = int(lengths[i])
        fits = mask >> need
        if fits:
            room = need + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                mask &= ~(1 << room)
        else:
            b, room = len(held), size
            held.append(0)
        bins[i], offsets[i] = b, held[b]
        held[b] += need
        by_room[room - need].append(b)
        mask |= 1 << (room - need)
    return bins, offsets, np.asarray(held, np.int64)


PACKED = PIECES + ", sequence long, offset long, bins long, bound long"


def exchange(lengths: np.ndarray, size: int, bound: int, tries: int = LAST_TRIES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """best_fit_decreasing(), then reruns over the loosest bins and some others while there are more bins than bound.

    Each try empties twice the excess of loosest bins and as many bins at random (seeded) as hold a few dozen pieces, and
    packs what was in them anew, in an order whose lengths are blurred a little; a result of no more bins replaces them.
    """
    bins, offsets, held = best_fit_decreasing(lengths, size)
    rng = np.random.default_rng(3)
    for k in range(tries):
        if len(held) <= bound:
            break
        room = size - held
        loose = np.argsort(-room, kind="stable")[: max(2, 2 * (len(held) - bound))]
        others = rng.permutation(len(held))[: 4 + k % 60]
        opened = np.union1d(loose, others)
        inside = np.flatnonzero(np.isin(bins, opened))
        blur = lengths[inside] * (1 + 0.1 * (k % 4) * rng.random(len(inside)))
        order = inside[np.argsort(-blur, kind="stable")]
        new_bins, new_offsets, new_held = best_fit_decreasing(lengths[order], size, in_order=True)
        if len(new_held) > len(opened):
            continue
        kept = np.setdiff1d(np.arange(len(held)), opened)
        number = np.full(len(held), -1)
        number[kept] = np.arange(len(kept))
        bins = number[bins]
        bins[order], offsets[order] = new_bins + len(kept), new_offsets
        held = np.concatenate([held[kept], new_held])
    return bins, offsets, held


def _pack_group(size: int, last: bool):
    """Packs one group; it marks the pieces of its loosest sequences for exchange with other groups.

    sequence -1 marks a piece for exchange. A group over its bound gives away as many sequences as hold twice the excess
    in free room, at least two; a certified group gives one, as its bound is rounded up and rooms of several groups may
    add up to a sequence. The kept ones stay as they are. The last group has no others: it exchanges within itself.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "uid"], ascending=[False, True], kind="stable").reset_index(drop=True)
        lengths = frame["length"].to_numpy(np.int64)
        bound = lower_bound(lengths, size)
        bins, offsets, held = exchange(lengths, size, bound, LAST_TRIES if last else 0)
        names = np.zeros(len(held), np.int64)
        first = frame.groupby(bins)["uid"].min()
        names[first.index.to_numpy()] = first.to_numpy()
        sequence = names[bins]
        room = size - held
        if not last and int(room.sum()):
            loose = np.argsort(-room, kind="stable")
            give = loose[: max(2, 2 * (len(held) - bound)) if len(held) > bound else 1]
            give = give[room[give] > 0]
            sequence = np.where(np.isin(bins, give), -1, sequence)
        return frame[["doc_id", "piece", "start", "length", "ids_crc32", "uid"]].assign(sequence=sequence, offset=offsets, bins=len(held), bound=bound)

    return run


def pack(docs: DataFrame, size: int = SEQUENCE, tokenizer: str = TOKENIZER, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """One row for each piece with its sequence_id and offset, and the bins and bound of the group that packed it.

    Full pieces are sequences by themselves (one bin, bound one). Others are packed in groups; what groups give away is
    dealt over fewer groups, until one is left, which holds at most a few sequences from each group of the round before.
    certificate() bounds the whole result.
    """
    ship(docs.sparkSession)
    cut_pieces = cut(pieces(docs, size, tokenizer), "pack-pieces")
    columns = [c.split()[0] for c in PIECES.split(", ")]
    one = F.lit(1).cast("long")
    full = cut_pieces.where(F.col("length") == size).select(*columns, F.col("uid").alias("sequence"), F.lit(0).cast("long").alias("offset"), one.alias("bins"), one.alias("bound"))
    pool = cut_pieces.where(F.col("length") < size)
    done, count, k = [full], pool.count(), 0
    groups = max(1, -(-count // group_pieces))
    while True:
        dealt = pool.withColumn("_pack_group", F.pmod(F.xxhash64(F.col("uid"), F.lit(k)), F.lit(groups)))
        packed = cut(dealt.groupBy("_pack_group").applyInPandas(_pack_group(size, groups == 1), PACKED), f"pack-round-{k}")
        done.append(packed.where("sequence >= 0").select(*columns, "sequence", "offset", "bins", "bound"))
        if groups == 1:
            break
        pool = packed.where("sequence < 0").select(*columns)
        groups, k = max(1, groups // MERGE), k + 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.withColumnRenamed("sequence", "sequence_id")


def certificate(packed: DataFrame, size: int = SEQUENCE) -> dict[str, int]:
    """sequences of a result and the fewest that any packing of its pieces needs, from counts of lengths alone.

    The driver gets one row for each length, size at most.
    """
    sequences = packed.select("sequence_id").distinct().count()
    counts = packed.groupBy("length").agg(F.count("*").alias("n")).collect()
    n = np.zeros(size + 1, np.int64)
    for row in counts:
        n[row["length"]] = row["n"]
    return {"sequences": sequences, "bound": bound_of_counts(n)}


def op9_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    packed = pack(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "bins", "bound")
