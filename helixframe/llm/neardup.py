"""Near-duplicate classes by ProbMinHash.

A text's five-word shingles, weighted by how often they occur, send arrivals of Poisson processes to a row of
registers; the element of a register's earliest arrival is its signature there, and two texts agree in a register
with their probability Jaccard similarity. Elements stop as soon as their next arrival is later than all registers
hold. Bands of registers propose partners, signatures sort them into coarse groups, and inside a coarse group the
exact similarity of the shingle weights decides. Classes are the components of links of 0.8 or more.

Texts with the same words are one text from the start, whatever their number. Buckets of more than GROUP texts are
coarse groups as they are. Coarse groups of up to GROUP texts are verified whole. A larger one is first dealt into
random parts, each with the texts that share most bands with others (the likeliest common origin). Two texts inside the
group's largest component need no comparison then. Of all others, rarity of shingles tells which texts can have a link
at all (an exact bound, with rows in proportion to the texts); those outside the component are compared with all that are
left, block by block. So no link of a group is left out, whatever its size.

Contract: a text without any word is alone in its class; texts of fewer than five words have one shingle; null texts
have no words; null doc_ids are allowed (a class of such rows only has a null class_id); repeated rows share
a class; an empty table gives an empty result; other columns are never read. class_id is the smallest doc_id. One
repeated row stays of each class, and of a class without any doc_id the row whose text has the smallest hash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, release, scratch, ship, table

WORDS = 5
SIMILAR = 0.8
REGISTERS, BANDS = 64, 16
ROWS = REGISTERS // BANDS
#: Registers that must agree before texts count as possibly similar: four standard errors under SIMILAR.
AGREE = int(np.ceil(REGISTERS * (SIMILAR - 4 * np.sqrt(SIMILAR * (1 - SIMILAR) / REGISTERS))))
#: Texts that one task compares at once, and common origins added to each part of a larger group.
GROUP, ORIGINS = 192, 16
#: Keys over which a shingle's rows are dealt where they meet what is known of it.
SALTS = 8
#: Shingles sketched at once.
BLOCK = 400_000

_WORD = re.compile(r"\w+")
_MIX = tuple(np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_STEP = np.uint64(0x9E3779B97F4A7C15)
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 100_000:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


_hashes = _Hashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def shingles(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes and how often each occurs."""
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - WORDS + 1)
    s = np.zeros(n, np.uint64)
    for k in range(min(WORDS, len(h))):
        s += h[k : k + n] * _FACTORS[k]
    return np.unique(_mixed(s), return_counts=True)


def signatures(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """Register signatures (texts x REGISTERS, uint16) of weighted elements that belong to texts 0 .. texts - 1.

    The j-th arrival of an element comes an exponential time of mean 1 / weight after the one before, at a
    random register; both follow from the element's hash and j alone.
    """
    earliest = np.full(texts * REGISTERS, np.inf)
    mark = np.zeros(texts * REGISTERS, np.uint16)
    latest = np.full(texts, np.inf)
    time = np.zeros(len(elements))
    e, w, o, j = elements, weights.astype(float), owner, 0
    while len(e):
        j += 1
        with np.errstate(over="ignore"):
            r = _mixed(e + _STEP * np.uint64(j))
            place = o * REGISTERS + (_mixed(r + _STEP) % np.uint64(REGISTERS)).astype(np.int64)
        time = time - np.log(((r >> np.uint64(11)).astype(float) + 0.5) / 2.0**53) / w
        sooner = np.flatnonzero(time < earliest[place])
        if len(sooner):
            sooner = sooner[np.argsort(-time[sooner], kind="stable")]  # the soonest is written last
            earliest[place[sooner]] = time[sooner]
            mark[place[sooner]] = (e[sooner] >> np.uint64(48)).astype(np.uint16)
            latest = earliest.reshape(texts, REGISTERS).max(1)
        going = time < latest[o]
        e, w, o, time = e[going], w[going], o[going], time[going]
    return mark.reshape(texts, REGISTERS)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact similarity: the sum over common d of 1 / sum_i max(x_i / x_d, y_i / y_d)."""
    both = np.union1d(a[0], b[0])
    if not len(both):
        return 0.0
    x, y = np.zeros(len(both)), np.zeros(len(both))
    x[np.searchsorted(both, a[0])] = a[1]
    y[np.searchsorted(both, b[0])] = b[1]
    x, y = x / x.sum(), y / y.sum()
    with np.errstate(divide="ignore"):
        ratio = np.where(y > 0, x / np.where(y > 0, y, 1), np.inf)
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    from_here = np.concatenate([np.cumsum(x[::-1])[::-1], [0.0]])
    before = np.concatenate([[0.0], np.cumsum(y)])
    common = np.flatnonzero((x > 0) & (y > 0))
    first = np.searchsorted(ratio, ratio[common], side="left")
    return float((1 / (from_here[first] / x[common] + before[first] / y[common])).sum())


def _texts(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))


def sketch_rows(docs: DataFrame) -> DataFrame:
    """doc_id, its text's hash, key (128 bits of the word sequence; null without words) and sig (registers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys: list[bytes | None] = []
            sigs: list[bytes | None] = [None] * batch.num_rows
            held: list[tuple[int, np.ndarray, np.ndarray]] = []

            def flush(held=held, sigs=sigs) -> None:
                if held:
                    sizes = [len(h) for _, h, _ in held]
                    marks = signatures(np.concatenate([h for _, h, _ in held]), np.concatenate([n for _, _, n in held]), np.repeat(np.arange(len(held)), sizes), len(held))
                    for (row, _, _), m in zip(held, marks, strict=True):
                        sigs[row] = m.astype("<u2").tobytes()
                    held.clear()

            size = 0
            for row, text in enumerate(batch.column(1)):
                words = words_of(text.as_py())
                keys.append(xxhash.xxh3_128_digest("\n".join(words)) if words else None)
                if words:
                    h, n = shingles(words)
                    held.append((row, h, n))
                    size += len(h)
                if size > BLOCK:
                    flush()
                    size = 0
            flush()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "text_hash", "key", "sig"])

    return _texts(docs).mapInArrow(run, "doc_id long, text_hash long, key binary, sig binary")


class _Union:
    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Groups of rows that agree in the first so many columns, of batches sorted by those.

    A group that goes on in the next batch is held back; groups are bounded by what deals them out.
    """
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        if held is not None:
            rows = pa.concat_tables([held, rows]).combine_chunks()
        ids = [rows.column(k).to_pylist() for k in range(keys)]
        ids = list(zip(*ids, strict=True))
        starts = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1])]
        for a, b in zip(starts, starts[1:], strict=False):
            yield rows.slice(a, b - a)
        held = rows.slice(starts[-1])
    if held is not None:
        yield held


def _stars(keys: list[bytes], union: _Union) -> list[tuple[bytes, bytes]]:
    """Edges from each component's first member to the others."""
    return [(keys[r], keys[i]) for i in range(len(keys)) if (r := union.find(i)) != i]


def _edges(judge):
    """judge(rows of a group, without its keys) gives edges: as a function of sorted batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[bytes, bytes]] = []

        def batch() -> pa.RecordBatch:
            a, b = zip(*out, strict=True) if out else ((), ())
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

        for group in judge(batches):
            out += group
            if len(out) > 10_000:
                yield batch()
        yield batch()

    return run


def _coarse(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[bytes, bytes]]]:
    """Joins texts of a bucket whose signatures agree in AGREE registers."""
    for group in _runs(batches, 1):
        if group.num_rows < 2:
            continue
        keys, sigs = group.column(1).to_pylist(), group.column(2).to_pylist()
        marks = np.frombuffer(b"".join(sigs), "<u2").reshape(len(keys), REGISTERS)
        union = _Union(len(keys))
        for i in range(len(keys) - 1):
            for k in np.flatnonzero((marks[i + 1 :] == marks[i]).sum(1) >= AGREE).tolist():
                union.join(i, i + 1 + k)
        yield _stars(keys, union)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[bytes, bytes]]]:
    """All against all in each part."""
    for group in _runs(batches, 3):
        if group.num_rows > 1:
            everyone = np.arange(group.num_rows)
            yield _verify(*(group.column(k).to_pylist() for k in (4, 5, 6)), everyone, everyone)


def _crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[bytes, bytes]]]:
    """A block of outsiders against a part of their group."""
    for group in _runs(batches, 3):
        outside = np.asarray(group.column(3).to_pylist(), bool)
        if outside.any() and not outside.all():
            yield _verify(*(group.column(k).to_pylist() for k in (4, 5, 6)), np.flatnonzero(outside), np.flatnonzero(~outside))


def _verify(keys: list[bytes], hashes: list[bytes], weights: list[bytes], left: np.ndarray, right: np.ndarray) -> list[tuple[bytes, bytes]]:
    """Joins texts, one among left and one among right, whose exact similarity is SIMILAR or more.

    Common shingles of all pairs come from products of the 0/1 matrix of shingles that two texts or more have.
    Where every shingle of both texts occurs once, they give the similarity; else the weights are compared
    pair by pair, only where the texts aren't joined yet and the most possible similarity suffices.
    """
    sets = [np.frombuffer(h, "<u8") for h in hashes]
    counts = [np.frombuffer(c, "<u4") for c in weights]
    n, whole = len(keys), left is right
    sizes = np.array([len(s) for s in sets])
    rows = np.repeat(np.arange(n), sizes)
    values, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(often > 1)
    place = np.full(len(values), -1)
    place[shared] = np.arange(len(shared))
    width = 4096
    at = place[column]
    order = np.argsort(at, kind="stable")
    at, of = at[order], rows[order]
    plain = np.array([bool((c == 1).all()) for c in counts])
    other = ~(plain[left][:, None] & plain[right][None])
    share = np.concatenate(counts)[order] / np.array([c.sum() for c in counts], float)[of]
    common = np.zeros((len(left), len(right)), np.float32)
    held, had = (np.zeros(common.shape, np.float32) for _ in range(2)) if other.any() else (None, None)
    for start in range(0, len(shared), width):
        a, b = np.searchsorted(at, [start, start + width])
        has = np.zeros((n, min(width, len(shared) - start)), np.float32)
        has[of[a:b], at[a:b] - start] = 1
        l, r = (has, has) if whole else (has[left], has[right])
        common += l @ r.T
        if held is not None:  # either text's weight in common shingles
            weight = np.zeros_like(has)
            weight[of[a:b], at[a:b] - start] = share[a:b]
            held += (weight if whole else weight[left]) @ r.T
            had += l @ (weight if whole else weight[right]).T
    jaccard = common / np.maximum(sizes[left][:, None] + sizes[right][None] - common, 1)
    union = _Union(n)
    wanted = np.triu(common > 0, 1) if whole else common > 0
    for i, k in np.argwhere(wanted & (jaccard >= SIMILAR) & ~other).tolist():
        union.join(int(left[i]), int(right[k]))
    if held is not None:
        unsure = np.argwhere(wanted & other & (np.minimum(held, had) >= SIMILAR - 1e-4))
        for i, k in unsure[np.argsort(-jaccard[tuple(unsure.T)], kind="stable")].tolist():
            i, k = int(left[i]), int(right[k])
            if union.find(i) != union.find(k) and probability_jaccard((sets[i], counts[i]), (sets[k], counts[k])) >= SIMILAR - 1e-9:
                union.join(i, k)
    return [(a, b) for a, b in _stars(keys, union) if a != b]


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node of each component. Both join sides come from written tables, so skewed
    labels can be split; the driver only learns whether a round changed anything."""
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    before = labels
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("m"))
        hooked = cut(labels.join(near, labels["node"] == near["a"]).select("node", F.least("label", "m").alias("label"), F.col("label").alias("old")), "hooked")
        target = hooked.select(F.col("node").alias("label"), F.col("label").alias("next"))
        jumped = cut(hooked.join(target, "label").select("node", F.least("label", "next").alias("label"), "old"), "jumped")
        release(before, hooked)
        labels, before = jumped.select("node", "label"), jumped
        if jumped.where("label != old").isEmpty():
            release(both)
            return labels


def _by_group(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a group in one task, next to each other, in order of key."""
    return rows.repartition(*keys).sortWithinPartitions(*keys, "key")


EDGES = "a binary, b binary"
#: Where a text goes for verification: a block of outsiders (0 in the first round), a part, and whether as an outsider.
PLACE = "array<struct<block:bigint,part:bigint,outside:boolean>>"


def _weighed(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted's key, label, size and places with each text's shingles (hashes, counts)."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # rows that repeat a doc_id and a text meet here
        for batch in batches:
            keep, hashes, counts = [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(4), strict=True):
                words = words_of(text.as_py())
                keep.append(bool(words) and key not in seen and xxhash.xxh3_128_digest("\n".join(words)) == key)
                if keep[-1]:
                    seen.add(key)
                    h, n = shingles(words)
                    hashes.append(h.astype("<u8").tobytes())
                    counts.append(n.astype("<u4").tobytes())
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([*(kept.column(k) for k in range(4)), pa.array(hashes, pa.binary()), pa.array(counts, pa.binary())], ["key", "label", "size", "places", "hashes", "counts"])

    texts = _texts(docs)
    same = texts["doc_id"].eqNullSafe(wanted["doc_id"]) & (texts["text_hash"] == wanted["text_hash"])
    # wanted grows with the input, so it is never broadcast, at no size
    fetched = texts.join(wanted.hint("merge"), same).select("key", "label", "size", "places", "text")
    return fetched.mapInArrow(weigh, f"key binary, label binary, size long, places {PLACE}, hashes binary, counts binary")


def _compared(weighed: DataFrame, judge) -> DataFrame:
    """Edges that judge finds among the texts at each place of their group."""
    dealt = weighed.withColumn("at", F.explode("places")).select("label", "at.block", "at.part", "at.outside", "key", "hashes", "counts")
    return _by_group(dealt, ["label", "block", "part"]).mapInArrow(_edges(judge), EDGES)


def _places(block, part, outside: bool):
    return F.struct(block.cast("long").alias("block"), part.cast("long").alias("part"), F.lit(outside).alias("outside"))


def _numbers(count):
    return F.sequence(F.lit(0).cast("long"), count - 1)


def _links(docs: DataFrame, found: DataFrame, members: DataFrame) -> DataFrame:
    """Verified links (a, b) inside coarse groups: found has key, label, size and where to find the text."""
    parts = F.ceil(F.col("size") / GROUP)
    part = F.pmod(F.xxhash64("key"), parts)
    reach = members.groupBy("key").agg(F.sum(F.log("n")).alias("reach"))
    origins = cut(
        found.where(F.col("size") > GROUP).join(reach, "key").groupBy("label", F.pmod(F.xxhash64("key"), F.lit(ORIGINS)).alias("slot")).agg(F.max_by("key", F.struct("reach", "key")).alias("key")).select("key", F.lit(True).alias("origin")),
        "near-origins",
    )
    none = F.lit(0)
    places = F.when(F.col("origin"), F.transform(_numbers(parts), lambda p: _places(none, p, False))).otherwise(F.array(_places(none, part, False)))
    wanted = cut(found.join(origins, "key", "left").select("doc_id", "text_hash", "key", "label", "size", places.alias("places")), "near-wanted")
    weighed = cut(_weighed(docs, wanted), "near-weighed")  # so that the texts move once only
    links = cut(_compared(weighed, _verified), "near-links")
    large = found.where(F.col("size") > GROUP)
    if large.isEmpty():
        return links

    first = components(links).withColumnRenamed("label", "component").withColumnRenamed("node", "key")
    split = cut(large.join(first, "key", "left").withColumn("component", F.coalesce("component", "key")), "near-split")
    main = split.groupBy("label", "component").agg(F.count("*").alias("n")).groupBy("label").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"))
    main = cut(main.where(F.col("all") > F.col("most")).select("label", "main"), "near-main")
    sides = split.join(main, "label").select("key", "label", (F.col("component") != F.col("main")).alias("outside"))
    open_texts = cut(weighed.where(F.col("size") > GROUP).select("key", "hashes", "counts").join(sides, "key"), "near-open")
    useful = cut(_linkable(open_texts), "near-linkable")
    sizes = cut(useful.groupBy("label").agg(F.ceil(F.count("*") / GROUP).alias("parts"), F.ceil(F.count_if("outside") / GROUP).alias("blocks")).where("blocks > 0"), "near-blocks")
    part, block = F.pmod(F.xxhash64("key"), F.col("parts")), F.pmod(F.xxhash64("key", F.lit(1)), F.col("blocks"))
    inside = F.transform(_numbers(F.col("blocks")), lambda b: _places(b, part, False))
    outside = F.when(F.col("outside"), F.transform(_numbers(F.col("parts")), lambda p: _places(block, p, True))).otherwise(F.array().cast(PLACE))
    again = cut(useful.join(sizes, "label").select("key", "label", F.concat(inside, outside).alias("places")), "near-again")
    return links.union(_compared(open_texts.select("key", "hashes", "counts").join(again, "key"), _crossed))


#: Most that the inverse shares of two texts in their common shingles add up to, and least share, where they are SIMILAR.
INVERSES, REST = 1 + 1 / SIMILAR, 1 - SIMILAR


def _linkable(texts: DataFrame) -> DataFrame:
    """key, label and outside of the texts that may have a link from outside their group's largest component.

    Where texts are SIMILAR, their weights in common shingles, cx and cy, have 1 / cx + 1 / cy <= INVERSES. With a text's
    shingles in order of how many texts of the group have them, rarest first, what stands before the first common
    shingle is not common, so the bound holds with 1 - before in place of c, and before is REST at most. A text stays if some
    shingle that others have meets this with the least weight before it among those others. Nothing is
    emitted for pairs; the rows are shingles that several texts of a group have.
    """

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [np.frombuffer(h, "<i8") for h in batch.column(3).to_pylist()]
            counts = [np.frombuffer(c, "<u4") for c in batch.column(4).to_pylist()]
            if not hashes:
                continue
            rows = pa.array(np.repeat(np.arange(len(hashes)), [len(h) for h in hashes]))
            share = np.concatenate([c / c.sum() for c in counts])
            columns = [batch.column(k).take(rows) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate(hashes)), pa.array(share)], ["key", "label", "outside", "shingle", "share"])

    spelled = texts.select("key", "label", "outside", "hashes", "counts").mapInArrow(spell, "key binary, label binary, outside boolean, shingle long, share double")
    spelled = cut(spelled, "near-spelled")
    by = ["label", "shingle"]
    often = spelled.groupBy(*by).agg(F.count("*").alias("n"), F.count_if("outside").alias("m")).where("n > 1")
    order = Window.partitionBy("key").orderBy("n", "shingle")
    known = spelled.join(often, by)
    # shingles of this text alone come before all others, and so does what rounding may add
    before = 1 - F.sum("share").over(Window.partitionBy("key")) + F.sum("share").over(order) - F.col("share") - 1e-8
    early = cut(known.withColumn("before", before).where((F.col("before") <= REST) & (F.col("m") > 0)).select(*by, "key", "outside", "before"), "near-early")
    least = early.groupBy(*by).agg(F.count("*").alias("rows"), F.min("before").alias("any"), F.min(F.when(F.col("outside"), F.col("before"))).alias("out")).where("rows > 1 AND out IS NOT NULL")
    # a shingle that a whole large group has is dealt over SALTS keys: one row for each on the small side
    least = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = early.withColumn("salt", F.pmod(F.xxhash64("key", F.lit(2)), F.lit(SALTS)).cast("int"))
    partner = F.when(F.col("outside"), F.col("any")).otherwise(F.col("out"))
    met = 1 / (1 - F.col("before")) + 1 / (1 - partner) <= INVERSES
    return salted.join(least, [*by, "salt"]).where(met).select("key", "label", "outside").distinct()


def _labelled(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and label of every document; label is null for texts without words."""
    spark = docs.sparkSession
    ship(spark)
    with scratch():
        rows = cut(sketch_rows(docs), "near-sketches")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
        nodes = cut(rows.where("key is not null").groupBy("key").agg(F.first("sig").alias("sig"), first.alias("at")).select("key", "sig", "at.doc_id", "at.text_hash"), "near-texts")
        band_of = F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring(F.col("sig"), b * (2 * ROWS) + 1, F.lit(2 * ROWS)))))
        bands = nodes.select("key", band_of.alias("band"))
        often = cut(bands.groupBy("band").agg(F.count("*").alias("n"), F.min("key").alias("head")).where("n > 1"), "near-buckets")
        members = cut(bands.join(often, "band").join(nodes.select("key", "sig"), "key"), "near-members")
        alike = _by_group(members.where(F.col("n") <= GROUP).select("band", "key", "sig"), ["band"]).mapInArrow(_edges(_coarse), EDGES)
        whole = members.where((F.col("n") > GROUP) & (F.col("key") != F.col("head"))).select(F.col("head").alias("a"), F.col("key").alias("b"))
        coarse = components(alike.union(whole))

        sizes = cut(coarse.groupBy("label").agg(F.count("*").alias("size")), "near-sizes")
        # what verification compares: the texts of coarse groups, fetched by their first row
        found = coarse.join(sizes, "label").withColumnRenamed("node", "key")
        found = cut(found.join(nodes.select("key", "doc_id", "text_hash"), "key"), "near-found")
        final = components(_links(docs, found, members))
        own = rows.select("doc_id", "text_hash", "key")
        return cut(own.join(final.select(F.col("node").alias("key"), "label"), "key", "left").select("doc_id", "text_hash", F.coalesce("label", "key").alias("label")), "near-labels", keep=True)


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id and class_size of every document."""
    labelled = _labelled(docs)
    alone = labelled.where("label is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    heads = cut(labelled.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size")), "near-heads")
    return labelled.join(heads, "label").select("doc_id", "class_id", "class_size").union(alone)


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class, that of the smallest doc_id, with all its columns.

    A row is found again by doc_id and its text's hash; rows that repeat both are one document.
    """
    number, text = F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), lambda h: F.xxhash64(h, F.col("doc_id").isNull())
    with scratch():
        labelled = _labelled(docs)
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("at")
        heads = labelled.where("label is not null").groupBy("label").agg(first).select("at.doc_id", "at.text_hash")
        empty = labelled.where("label is null").select("doc_id", "text_hash").distinct()
        # two keys without nulls, so that the join's partitions also serve to leave out repeated rows
        kept = cut(heads.union(empty).select(number.alias("_near_id"), text(F.col("text_hash")).alias("_near_text")), "near-kept", keep=True)
    keyed = docs.withColumn("_near_id", number).withColumn("_near_text", text(F.xxhash64(F.col("text").cast("string"))))
    return keyed.join(kept, ["_near_id", "_near_text"], "left_semi").dropDuplicates(["_near_id", "_near_text"]).select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_probminhash_classes(spark, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
