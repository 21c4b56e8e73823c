"""The corpus operators against brute force, round trips and held-out accuracy, and their behaviour on odd rows."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.llm import common, fingerprint, language, licenses, mixing, mtree, neardup, packing, secrets, toxicity, warc

SF = "/root/testdata/sf0.01"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """rows of (doc_id, text, source) with columns whose names clash with the operators' own."""
    full = [(i, t, "en", s, None if t is None else len(t), "x", 7, None) for i, t, s in rows]
    return spark.createDataFrame(full, DOC + ", size string, key int, label string")


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"w{i % 997}" for i in range(30_000))
    rows = [(1, "one two three four five six seven", "a"), (1, "one two three four five six seven", "a"), (2, None, "a"), (3, "", None), (4, "   \n\t ", "b"), (None, "some text without an id at all", "b"), (None, None, None), (5, long, "c"), (6, long + " tail", None), (7, "Ünïcödé 漢字 ½ <|endoftext|> İ", "c"), (8, "word", "d")]
    return documents(spark, rows)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("1 = 0")


def test_every_operator_takes_odd_and_empty_tables(spark, odd, empty):
    labels = spark.createDataFrame([(1, None), (2, 1), (2, 0), (None, 1), (3, 0)], "doc_id long, toxic int")
    secret_model = secrets.train()
    for docs in (odd, empty):
        n = docs.count()
        planned = mixing.plan(docs).collect()
        assert len(planned) == n and all(r["size"] == 0 for r in planned if r["doc_id"] in (2, 3, 4)) and all(0 <= r["taken"] <= 2 * r["size"] for r in planned)
        mixed = mixing.mix(docs)
        assert mixed.columns == docs.columns
        copies = Counter((r["doc_id"], r["source"]) for r in mixed.collect())
        wanted = Counter()
        for r in planned:
            wanted[r["doc_id"], r["source"]] += r["repetitions"]
        assert copies == +wanted
        assert toxicity.passages(docs, toxicity.train(docs, labels)).count() == n
        assert toxicity.reject_toxic(docs, toxicity.Model({})).count() <= n
        assert len(secrets.scan(docs, secret_model).collect()) == 0
        assert secrets.redact(docs, secret_model).count() == n
        got = neardup.classes(docs)
        assert got.count() == n
        kept = neardup.keep_one(docs)
        assert kept.columns == docs.columns
        kept.collect()
        prints = fingerprint.fingerprints(docs).collect()
        assert len(prints) == n and all(r["n_chars"] == 0 and r["fingerprint"].startswith("0:") for r in prints if r["doc_id"] in (2, 3))
        assert len({r["fingerprint"] for r in prints if r["doc_id"] == 1}) <= 1 and all(r["n_chars"] > 100_000 for r in prints if r["doc_id"] in (5, 6))
        assert language.identify(docs, language.train(docs)).count() == n
        licenses.scan(docs).collect()
        packed = packing.pack(docs).toPandas()
        assert packed["uid"].nunique() == len(packed) >= n
    pages = spark.createDataFrame([(1, None, None, "x"), (None, "u", "<p>a", "y"), (2, "v", "", "z")], "page_id long, url string, html string, block string")
    records = warc.derive(warc.responses(pages), ("page_id",)).collect()
    assert len(records) == 6 and {(r["page_id"], r["block"]) for r in records if r["record_type"] == "conversion"} == {(1, ""), (None, "a"), (2, "")}
    assert warc.derive(warc.responses(pages.where("1 = 0"))).collect() == []
    broken = spark.createDataFrame([(1, "http://a/\r\nX-Header: 1", "<a href='b\nc'>")], "page_id long, url string, html string")
    for r in warc.as_warc(warc.derive(warc.responses(broken))).collect():
        assert b"\nX-Header" not in r["warc"] and b"%0D%0AX-Header" in r["warc"]
    vectors = spark.createDataFrame([(0, [0.5, 0.5], "a"), (0, [0.5, 0.5], "a"), (50, [1.0, -1.0], "b"), (51, None, "c"), (52, [float("nan"), 1.0], "d"), (53, [None, 1.0], "e"), (None, [1.0, 1.0], "f"), (54, [float("inf"), 0.0], "g"), (55, [0.25], "h"), (56, [], "i")], "vec_id long, embedding array<double>, v string")
    # two rows 0 and one row 50 ask; four other rows are candidates of each, a repeated row among them
    assert Counter(r["query_id"] for r in mtree.top_k(vectors).collect()) == {0: 8, 50: 4}
    assert mtree.top_k(vectors.where("1 = 0")).count() == 0


# 1 ------------------------------------------------------------------------------------------------------------------

def fill(sizes, weights, share, most):
    left, free, target = share * sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while free:
        w = sum(weights[i] for i in free)
        over = [i for i in free if weights[i] * left / w > most * sizes[i]]
        if not over:
            for i in free:
                target[i] = weights[i] * left / w
            break
        worst = max(over, key=lambda i: weights[i] / max(sizes[i], 1e-9))
        target[worst] = most * sizes[worst]
        left -= target[worst]
        free.discard(worst)
    return target


def test_mixing_by_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 40))), rng.choice(["a", "b", "c", "d", None, "big", "big", "big"])) for i in range(600)]
    out = mixing.plan(documents(spark, rows)).toPandas()
    names = ["a", "b", "big", "c", "d", None]
    sizes = [sum(len(t.split()) for _, t, s in rows if s == n) for n in names]
    target = fill(sizes, [3, 1, 2, 3, 1, 2], 1.5, 2)
    for n, size, t in zip(names, sizes, target, strict=True):
        own = out[out["source"].isna() if n is None else out["source"] == n]
        assert (own["source_size"] == size).all() and np.allclose(own["target"], t)
        assert abs(own["taken"].sum() - t) <= own["size"].max() / 2 + 1
        assert (own["taken"] <= 2 * own["size"]).all() and (own["taken"] == own["size"] * own["repetitions"]).all()
    again = mixing.plan(documents(spark, rows)).toPandas()
    assert sorted(map(tuple, again[["doc_id", "taken"]].to_numpy())) == sorted(map(tuple, out[["doc_id", "taken"]].to_numpy()))
    mixed = mixing.mix(documents(spark, rows)).groupBy("doc_id").count().toPandas().set_index("doc_id")["count"].to_dict()
    assert all(mixed.get(r.doc_id, 0) == r.repetitions for r in out.itertuples())


# 2 ------------------------------------------------------------------------------------------------------------------

def test_warc_round_trip(spark):
    html = '<!DOCTYPE html><html lang="de"><head><title>A &amp; B</title><script>x<y</script></head><body><!-- no --><p>One<br>two &lt;3</p><div>three  four</div><a href="/x">five</a></body></html>'
    pages = spark.createDataFrame([(1, "http://a/", html)], "page_id long, url string, html string")
    records = warc.derive(warc.responses(pages), ("page_id",)).cache()
    rows = {r["record_type"]: r for r in records.collect()}
    assert rows["conversion"]["block"] == "One\ntwo <3\nthree four\nfive"
    assert "title: A & B\r\nlanguage: de" in rows["metadata"]["block"] and "outlink: /x" in rows["metadata"]["block"]
    response = warc.responses(pages).first()
    assert rows["conversion"]["refers_to"] == rows["metadata"]["refers_to"] == response["record_id"]
    for r in warc.as_warc(records).collect():
        head, _, rest = bytes(r["warc"]).partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        body = rest[: int(fields["Content-Length"])]
        assert rest[len(body) :] == b"\r\n\r\n" and fields["WARC-Refers-To"] == f"<{response['record_id']}>" and fields["WARC-Record-ID"] == f"<{r['record_id']}>"
        import hashlib

        assert fields["WARC-Block-Digest"] == "sha1:" + hashlib.sha1(body).hexdigest()


# 3 ------------------------------------------------------------------------------------------------------------------

def segments_by_definition(v):
    out = []

    def rec(a, b):
        best = None
        for i in range(a, b):
            s = 0.0
            for j in range(i, b):
                s += v[j]
                if s > 0 and (best is None or s > best[0] + 1e-9):
                    best = (s, i, j + 1)
        if best:
            rec(a, best[1])
            out.append((best[1], best[2], round(best[0], 6)))
            rec(best[2], b)

    rec(0, len(v))
    return out


def test_segments_by_definition():
    rng = random.Random(0)
    for _ in range(300):
        v = np.array([rng.choice([-3.1, -2.03, -1.07, 0.5, 1.21, 2.9]) for _ in range(rng.randint(0, 25))])
        assert [(a, b, round(s, 6)) for a, b, s in toxicity.segments(v)] == segments_by_definition(v)


def test_repeats_are_capped_within_each_segment():
    bad = [f"bad{k}" for k in range(6)]
    model = toxicity.Model(dict.fromkeys(bad, 2.0))
    filler = [f"w{k}" for k in range(40)]
    words = [w for b in bad * 2 for w in (b, *filler)] + 2 * (bad + filler) + bad
    _, found, _ = toxicity.score_text(model, toxicity._Cache(model), " ".join(words))
    dense = len(words) - 2 * (len(bad) + len(filler)) - len(bad)
    assert [s for s in found if s[2] > 11] == [(a, a + 6, 12.0) for a in (dense, dense + 46, dense + 92)]
    _, found, _ = toxicity.score_text(model, toxicity._Cache(model), "bad0 " * 5)
    assert found == [(0, 2, 4.0), (2, 4, 4.0), (4, 5, 2.0)]


def test_capped_segments_by_definition():
    rng = random.Random(8)
    for _ in range(200):
        score = {w: rng.choice([-1.07, -0.35, 0.5, 1.21, 2.9]) for w in "abcdef"}
        words = rng.choices("abcdef", k=rng.randint(0, 25))
        every = []
        for a in range(len(words)):
            seen, total = Counter(), 0.0
            for b in range(a, len(words)):
                seen[words[b]] += 1
                total += score[words[b]] if score[words[b]] <= 0 or seen[words[b]] <= toxicity.REPEATS else -toxicity.DROP
                every.append((a, b + 1, total))
        found = toxicity.capped_segments(np.array([score[w] for w in words]), words)
        assert {(a, b, round(v, 6)) for a, b, v in found} <= {(a, b, round(v, 6)) for a, b, v in every}
        assert all(any(f[2] > v - 1e-9 and f[0] < b and a < f[1] for f in found) for a, b, v in every if v > 1e-9)
        assert all(f is g or f[1] <= g[0] or g[1] <= f[0] for f in found for g in found)


def test_toxic_score_by_definition():
    """Segments by taking the best run of tokens and going on left and right of it; the score from their expectations."""
    rng = random.Random(12)
    for _ in range(60):
        words = [f"w{k}" for k in range(rng.randint(0, 40))]
        scores = {w: rng.choice([-2.0, -0.5, 0.75, 1.5, 3.0]) * rng.random() for w in words}
        model = toxicity.Model(scores, decay=0.9, weight=0.05, a=-4.0, b=1.5)

        def parts(a, b, v=[scores[w] for w in words]):  # noqa: B006
            runs = [(sum(v[i:k]), -i, -k) for i in range(a, b) for k in range(i + 1, b + 1)]
            if not runs or max(runs)[0] <= 0:
                return []
            total, i, k = max((round(s, 9), i, k) for s, i, k in runs)
            return [*parts(a, -i), total, *parts(-k, b)]

        evidence = sum(max(0.0, -math.log10(0.05 * max(len(words), 1) * math.exp(-0.9 * s))) for s in parts(0, len(words)))
        want = 1 / (1 + math.exp(4.0 - 1.5 * math.log1p(evidence)))
        assert toxicity.score_text(model, toxicity._Cache(model), " ".join(words))[0] == pytest.approx(want, abs=1e-9)


def test_log_odds_by_hand():
    counts = {"bad": (30, 2), "good": (10, 60), "^bad": (30, 2)}
    got = toxicity.log_odds(counts, prior=1.0, sure=1.0)
    alpha = 2 / 2 * (32 / 102 + 1 / 2)
    odds = math.log((30 + alpha) / 42) - math.log((2 + alpha) / 64)
    assert got["bad"] == pytest.approx(odds - math.sqrt(1 / (30 + alpha) + 1 / (2 + alpha))) and got["good"] < 0
    assert toxicity.evidence(["a", "a", "a", "b"])["a"] == toxicity.REPEATS and toxicity.evidence(["abcde", "abcdf"])["^abcd"] == 2


def test_toxic_documents_are_found(spark):
    rng = random.Random(2)
    words = ["".join(rng.choices("aeioulmnrst", k=rng.randint(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(1500):
        text, bad = [rng.choice(words) for _ in range(rng.randint(10, 80))], i % 5 == 0
        if bad:
            for _ in range(3):
                text.insert(rng.randint(0, len(text)), rng.choice(["zblorg", "quaxit", "vrunk" + rng.choice("abcdefg")]))
        rows.append((i, " ".join(text), "s"))
        labels.append((i, int(bad)))
    docs = documents(spark, rows)
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = toxicity.passages(docs, model).toPandas().set_index("doc_id")
    truth = dict(labels)
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(got.score[i] >= 0.7) == truth[i] for i in held]) > 0.98
    assert all(any("zblorg" in p["words"] or "quaxit" in p["words"] or "vrunk" in p["words"] for p in got.passages[i]) for i in held if truth[i])
    kept = {r[0] for r in toxicity.reject_toxic(docs, model).select("doc_id").collect()}
    assert kept == {i for i in truth if got.score[i] < 0.7}


# 4 ------------------------------------------------------------------------------------------------------------------

def test_forest_by_kind():
    """Fresh findings of each kind; passwords of words and digits among them."""
    found = secrets.rates(secrets.train(), secrets.findings_by_kind(4000, 99))
    assert set(secrets.SECRET_KINDS) <= set(found)
    for kind, (n, share) in found.items():
        assert n > 50 and (share >= 0.9 if kind in secrets.SECRET_KINDS else share <= 0.05), (kind, share)


def test_findings_from_a_table(spark):
    rows = [("password = hunter2024secure x", None, 1), ("commit 0123456789abcdef", "a.py", 0), (None, "a", 1), ("x", "a", None)]
    assert sorted(secrets.findings_of(spark.createDataFrame(rows, "text string, path string, label int"))) == [("commit 0123456789abcdef", "a.py", 0), ("password = hunter2024secure x", "", 1)]
    assert [c.value for c in secrets.candidates("key=zq8Xw71LmPq0RtY5vB2n==")] == ["zq8Xw71LmPq0RtY5vB2n=="]


def test_forest_on_held_out_findings():
    model = secrets.train()
    held = secrets.labelled_findings(800, seed=123)
    judged = secrets.judge(model, [t for t, _, _ in held], [p for _, p, _ in held])
    right = [(max(p for _, p in cs) >= 0.5) == (y == 1) for cs, (_, _, y) in zip(judged, held, strict=True) if cs]
    assert len(right) > 700 and np.mean(right) > 0.97


def test_secrets_are_found_and_redacted(spark):
    key, word = "AKIA" + "Q2W3E4R5T6Y7U4I2", "9f86d081884c7d65"
    docs = documents(spark, [(1, f"see {key} here", "s"), (2, f"set password={word} now", "s"), (3, f"commit {'ab12' * 10} was merged", "s"), (4, "nothing here", "s")])
    model = secrets.train()
    got = {(r["doc_id"], r["value"]): r["secret"] for r in secrets.scan(docs, model).collect()}
    assert got[1, key] and got[2, word] and not got[3, "ab12" * 10]
    texts = {r["doc_id"]: (r["text"], r["n_chars"]) for r in secrets.redact(docs, model).collect()}
    assert texts[1] == ("see [SECRET] here", 17) and texts[2][0] == "set password=[SECRET] now" and texts[4][0] == "nothing here"


def test_private_keys_stay_findings(spark):
    import base64

    rng, rows, blocks = random.Random(77), [], []
    for source in ("", "src/main.py", "tests/fixtures/a.py", "docs/example.md"):
        for kind in ("", "RSA ", "EC ", "OPENSSH "):
            for size in (48, 118, 608, 1192, 2350):
                body = base64.b64encode(rng.randbytes(size)).decode()
                blocks.append("\n".join([f"-----BEGIN {kind}PRIVATE KEY-----", *(body[i : i + 64] for i in range(0, len(body), 64)), f"-----END {kind}PRIVATE KEY-----"]))
                rows.append((len(rows), f"example key of the test\n{blocks[-1]}\nand more", source))
    docs, model = documents(spark, rows), secrets.train()
    found = {r["doc_id"]: r for r in secrets.scan(docs, model).collect()}
    assert all(found[i]["kind"] == "private_key" and found[i]["value"] == block and found[i]["secret"] for i, block in enumerate(blocks))
    assert {r["text"] for r in secrets.redact(docs, model).collect()} == {"example key of the test\n[SECRET]\nand more"}


def test_credentials_of_letters_alone_are_found(spark):
    rng, letters = random.Random(9), "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    values = ["".join(rng.choices(letters, k=20 + i % 20)) for i in range(200)]
    names = ["updateUserSessionStateHandler", "DefaultConnectionPoolFactory", "internationalization", "AAAAAAAAAAAAAAAAAAAAAAAA"]
    rows = [(i, f"see {v} here", "s") for i, v in enumerate(values + names)]
    found = [r["value"] for r in secrets.scan(documents(spark, rows), secrets.train()).collect() if r["secret"]]
    assert len(set(found) & set(values)) >= 190 and not set(found) & set(names)


# 5 ------------------------------------------------------------------------------------------------------------------

def exact_jp(a, b):
    total = 0.0
    for d in a.keys() & b.keys():
        total += 1 / sum(max(a.get(i, 0) / a[d], b.get(i, 0) / b[d]) for i in a.keys() | b.keys())
    return total


def test_probability_jaccard_and_registers():
    rng = random.Random(3)
    errors = []
    for _ in range(60):
        n = rng.randint(20, 60)
        a = {i: rng.randint(1, 4) for i in range(n)}
        b = {i: rng.randint(1, 4) for i in range(rng.randint(0, n // 2), n + 8)}
        want = exact_jp(a, b)
        arrays = [(neardup._mixed(np.array(sorted(x), np.uint64)), np.array([x[k] for k in sorted(x)])) for x in (a, b)]
        arrays = [(h[o], c[o]) for h, c in arrays for o in [np.argsort(h)]]
        assert neardup.probability_jaccard(*arrays) == pytest.approx(want)
        marks = neardup.signatures(np.concatenate([arrays[0][0], arrays[1][0]]), np.concatenate([arrays[0][1], arrays[1][1]]), np.repeat([0, 1], [len(a), len(b)]), 2)
        errors.append((marks[0] == marks[1]).mean() - want)
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.12


def test_near_classes_by_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    base = [[rng.choice("abcdefghij") + str(rng.randint(0, 500)) for _ in range(60)] for _ in range(12)]
    texts = []
    for b in base:
        for _ in range(rng.randint(1, 25)):
            t = list(b)
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = "x" + str(rng.randint(0, 10**6))
            texts.append(" ".join(t * rng.choice([1, 1, 1, 2])))
    texts += [texts[0]] * 5 + ["alone and short", "alone and short", "", None]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    want = list(range(len(texts)))
    found = lambda i: i if want[i] == i else found(want[i])
    sets = [neardup.shingles(neardup.words_of(t)) if t else None for t in texts]
    for i in range(len(texts)):
        for k in range(i):
            if sets[i] is not None and sets[k] is not None and neardup.probability_jaccard(sets[i], sets[k]) >= 0.8 - 1e-9:
                want[max(found(i), found(k))] = min(found(i), found(k))
    got = {r["doc_id"]: (r["class_id"], r["class_size"]) for r in neardup.classes(documents(spark, rows)).collect()}
    sizes = Counter(found(i) for i in range(len(texts)))
    assert got == {i: (found(i), sizes[found(i)]) for i in range(len(texts))}
    assert {found(i) for i in range(len(texts))} == {r["doc_id"] for r in neardup.keep_one(documents(spark, rows)).collect()}
    monkeypatch.setattr(neardup, "GROUP", 4)  # buckets and groups of more than 4 texts are dealt into parts
    monkeypatch.setattr(neardup, "ORIGINS", 1)
    parts = {r["doc_id"]: r["class_id"] for r in neardup.classes(documents(spark, rows)).collect()}
    assert parts == {i: found(i) for i in range(len(texts))}


def test_near_links_of_a_chain_in_a_large_group(spark, monkeypatch):
    """Texts that drift apart word by word: each links to its neighbours alone, and no part holds them all."""
    rng = random.Random(8)
    text = [f"w{rng.randint(0, 10**6)}" for _ in range(200)]
    rows = []
    for i in range(60):
        rows.append((i, " ".join(text), "s"))
        for k in range(2):
            text[(i * 7 + k * 100) % 200] = f"n{i}x{k}"
    rows += [(100 + i, " ".join(f"z{i}y{k}" for k in range(50)), "s") for i in range(5)] + [(None, rows[3][1], "s"), (None, "no number here at all", "s"), (None, "no number here at all", "s")]
    monkeypatch.setattr(neardup, "GROUP", 6)
    monkeypatch.setattr(neardup, "ORIGINS", 2)
    docs = documents(spark, rows)
    got = [(r["doc_id"], r["class_id"]) for r in neardup.classes(docs).collect()]
    assert Counter(got) == Counter([(i, 0) for i in range(60)] + [(None, 0)] + [(100 + i, 100 + i) for i in range(5)] + [(None, None)] * 2)
    assert Counter(r["doc_id"] for r in neardup.keep_one(docs).collect()) == Counter([0, *range(100, 105), None])


# 6 ------------------------------------------------------------------------------------------------------------------

def test_fingerprints_of_all_documents(spark):
    docs = common.table(spark, SF, "documents")
    import hashlib

    got = fingerprint.fingerprints(docs).toPandas().set_index("doc_id")
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), reverse=True)
    real = []
    words = lambda x: "".join(c if c.isalpha() or c.isnumeric() else " " for c in x.lower()).split()
    shingles = lambda w: [tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))] if w else []
    short = 0
    for k, (i, t) in enumerate(rows):
        one, two = shingles(words(t)), shingles(words(rows[(k + 1) % len(rows)][1]))
        a, b = set(one), set(two)
        if max(len(one), len(two)) <= fingerprint.SHORT:  # all hashes are kept: the estimate is the similarity itself
            short += 1
            assert got.near_next[i] == (1.0 if one == two else len(a & b) / max(1, len(a | b)))
        elif min(len(a), len(b)) > 400:
            assert abs(got.near_next[i] - len(a & b) / len(a | b)) < 0.2
        after = rows[(k + 1) % len(rows)][1]
        third = len(t) // 3
        edited = t[: len(t) - third] + after[:third]
        assert got.edited_sha256[i] == hashlib.sha256(edited.encode()).hexdigest() and got.n_chars[i] == len(t)
        sets = []
        for x in (t, edited):
            w = [y for y in "".join(c if c.isalpha() or c.isnumeric() else " " for c in x.lower()).split()]
            sets.append({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))})
        if min(map(len, sets)) > 400:
            real.append(got.near_edited[i] - len(sets[0] & sets[1]) / len(sets[0] | sets[1]))
    assert len(real) > 100 and abs(np.mean(real)) < 0.01 and np.max(np.abs(real)) < 0.2
    assert short > 0
    equal = {}
    for i, t in rows:
        assert equal.setdefault(t, got.fingerprint[i]) == got.fingerprint[i]


def test_fingerprints_over_many_ranges(spark, monkeypatch):
    """Small ranges, rows without doc_id and repeated ids: each row is followed by the next one in the whole order."""
    monkeypatch.setattr(fingerprint, "RANGE_BYTES", 400)
    rng = random.Random(4)
    rows = [(rng.choice([None, *range(90)]), " ".join(f"w{rng.randint(0, 40)}" for _ in range(rng.randint(0, 20))), "s") for _ in range(160)]
    docs = documents(spark, rows)
    got = Counter((r["doc_id"], r["edited_sha256"]) for r in fingerprint.fingerprints(docs).collect())
    import hashlib

    ties = {r["text"]: r["h"] for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(((i, t) for i, t, _ in rows), key=lambda r: (r[0] is None, -(r[0] or 0), ties[r[1]]))
    want = Counter()
    for k, (i, t) in enumerate(order):
        third = len(t) // 3
        want[i, hashlib.sha256((t[: len(t) - third] + order[(k + 1) % len(order)][1][:third]).encode()).hexdigest()] += 1
    assert got == want


# 7 ------------------------------------------------------------------------------------------------------------------

def test_languages_held_out(spark):
    docs = common.table(spark, SF, "documents")
    got = language.op7_language_mixture(spark, SF).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    held = got[got["held_out"]]
    assert (held["lang"] == held["lang_pred"]).mean() > 0.95 and got["score"].between(0, 1).all()


def test_ngrams_of_long_texts_and_neighbours(monkeypatch):
    rng = random.Random(1)
    for _ in range(20):
        texts = ["".join(rng.choices("abcé  1,\n.ßñ中", k=rng.choice([0, 1, 2, 5, 50, 300]))) for _ in range(4)]
        alone = [language.slots_of([t]) for t in texts]
        who, slot, n = language.slots_of(texts)
        for k, (_, s, c) in enumerate(alone):
            assert slot[who == k].tolist() == s.tolist() and n[who == k].tolist() == c.tolist()
        for block in (3, 50):
            monkeypatch.setattr(language, "BLOCK", block)
            for t, one in zip(texts, alone, strict=True):
                if len(t) > block:
                    assert all(np.array_equal(x, y) for x, y in zip(one, language._long(t), strict=True))
            monkeypatch.undo()
    assert len(language.slots_of(["\U00032100" * 5])[0])


def test_language_mixture(spark):
    model = language.train(common.table(spark, SF, "documents"))
    texts = {r["lang"]: r["text"] for r in common.table(spark, SF, "documents").where("n_chars between 1500 and 2500").collect()}
    w, kept = language.infer(model, [texts["en"] + " " + texts["fr"], texts["de"], "12 3.4", ""])
    en, fr, de = (model.languages.index(x) for x in ("en", "fr", "de"))
    assert kept[0, en] and kept[0, fr] and w[0, en] > 0.2 and w[0, fr] > 0.2 and w[1].argmax() == de and not kept[2:].any()


# 8 ------------------------------------------------------------------------------------------------------------------

def test_licences_by_brute_force(spark):
    lines = ["Licensed under the Apache License, Version 2.0.", "released under the mit licence", "This work is licensed under the GNU General Public License, version 3.", "plain words of no licence at all", licenses.TEMPLATES["MIT"][2].replace("copies", "duplicates")]
    rng = random.Random(1)
    rows = [(i, "\n".join(rng.choices(lines, k=rng.randint(1, 4))), "s") for i in range(40)]
    got = {(r["doc_id"], r["start"], r["end"], r["license"], r["template"], round(r["dice"], 9)) for r in licenses.scan(documents(spark, rows)).collect()}
    want = set()
    for i, t, _ in rows:
        spans, at = {(0, len(t))}, 0
        for line in t.split("\n"):
            spans.add((at, at + len(line)))
            at += len(line) + 1
        for a, b in spans:
            own = licenses.bigrams(licenses.normalise(t[a:b]))
            for name, texts in licenses.TEMPLATES.items():
                for k, x in enumerate(texts):
                    d = licenses.dice(own, licenses.bigrams(licenses.normalise(x)))
                    if d >= 0.8:
                        want.add((i, a, b, name, k, round(d, 9)))
    assert got == want and want


def test_notices_over_paragraphs_and_within_lines():
    mit, gpl = licenses.TEMPLATES["MIT"][2], licenses.TEMPLATES["GPL-3.0"][1]
    above, software = mit.index("The above"), mit.index("THE SOFTWARE IS")
    layout = f"{mit[:above]}\n\n{mit[above:software]}\n\n{mit[software:]}"
    useful = gpl.index("This program is distributed")
    header = "\n\n".join("# " + part.replace(", ", "\n# ") for part in (gpl[:useful], gpl[useful:]))
    code = "\u0130 def f(x):\n    return x  # some code\n\n" * 30
    sentence = "İstanbul notes, long ago. This work is licensed under a Creative Commons Attribution 4.0 International License. More words follow on the same line."
    for name, k, notice, text in (("MIT", 2, layout, f"Copyright (c) 2020 A\n\n{layout}\n\n{code}"), ("GPL-3.0", 1, header[2:], f"{code}{header}\n\n{code}"), ("CC-BY-4.0", 1, "This work is licensed under a Creative Commons Attribution 4.0 International License", sentence)):
        best = [m for m in licenses.Scanner().scan(text) if m["best"]]
        assert [(m["unit"], m["license"], m["template"]) for m in best] == [("passage", name, k)] and best[0]["dice"] > 0.99
        assert text[best[0]["start"] : best[0]["end"]] == notice.rstrip(".")
    assert len([m for m in licenses.Scanner().scan(f"{code}{layout}\n\n{code}{layout}\n{code}") if m["best"]]) == 2


def test_complete_licence_texts_are_found():
    disclaimer = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
    scanner = licenses.Scanner()
    for name in ("BSD-2-Clause", "BSD-3-Clause"):
        found = scanner.scan(f"Copyright (c) 2020 A\n\n{licenses.TEMPLATES[name][1]}\n\n{disclaimer}\n")
        assert any(m["unit"] == "document" and m["license"] == name and m["best"] for m in found)
    for name in ("Apache-2.0", "ISC", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "EPL-2.0", "BSL-1.0", "CC0-1.0", "Unlicense", "Zlib"):
        text = licenses.TEXTS[name]
        for whole in (text, "some code\n" * 30_000 + text + "\nmore code" * 30_000):
            assert any(m["license"] == name and m["best"] and m["end"] - m["start"] > 0.9 * len(text) for m in scanner.scan(whole)), name


def test_licence_windows_by_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        template = rng.choices("abcd", k=rng.randint(3, 7))
        words = rng.choices("abcdef", k=rng.randint(0, 40))
        scanner = licenses.Scanner({"x": (" ".join(template),)})
        pairs = list(zip(words, words[1:], strict=False))
        found = {(round(d, 9), a, b) for t, p in scanner.near(pairs).items() for d, a, b in scanner.windows(t, pairs, p, [])}
        every = {(round(licenses.dice(licenses.bigrams(words[a:b]), licenses.bigrams(template)), 9), a, b) for a in range(len(words)) for b in range(a + 2, len(words) + 1)}
        every = {w for w in every if w[0] >= 0.8}
        assert found <= every and all(any(f[0] >= d and f[1] < b and a < f[2] for f in found) for d, a, b in every)
        assert all(f == g or f[2] <= g[1] or g[2] <= f[1] for f in found for g in found)


# 9 ------------------------------------------------------------------------------------------------------------------

def test_ids_equal_the_tokenizer():
    texts = ["It's a TEST, we've 42 things!! (x_y) don't", "Ünïcödé straße ÀÉÎ", "漢字 and ½ İstanbul ﬁ", "a<|endoftext|>b", "tabs\tand\nlines \r\n x", "", "é", "naïve 'tis ''s 's", "x" * 300, "\x00\x1f odd", "½²ª"]
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    texts += [" ".join(f"{a}{b}" for a in ("it's", "''ll", "é9", "x_", "ß", "--", "42abc", "'d") for b in ("", "q", "?!", "7"))]
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    for x, ids in zip(texts, want, strict=True):
        assert list(np.frombuffer(packing.ids_bytes(x), "<u4")) == ids, x
    assert packing.ranks_suffice()
    rng = random.Random(2)
    words = ["".join(rng.choices(letters, k=rng.randint(1, 24))) for letters in ("abc", "etaoinshrdlu", "abcdefghijklmnopqrstuvwxyzßàé", "!?.,-()") for _ in range(800)]
    for x in (" ".join(words[k : k + 50]) for k in range(0, len(words), 50)):
        assert list(np.frombuffer(packing.ids_bytes(x), "<u4")) == t.encode(x, add_special_tokens=False).ids
    packing._stores.clear()  # all at once, with nothing known
    assert [list(np.frombuffer(x, "<u4")) for x in packing.all_ids_bytes(texts)] == want


def best_bins(lengths, size):
    for n in range(1, len(lengths) + 1):
        held = [0] * n

        def place(k, held=held):
            if k == len(lengths):
                return True
            for b in sorted(set(range(len(held))), key=lambda i: held[i]):
                if held[b] + lengths[k] <= size:
                    held[b] += lengths[k]
                    if place(k + 1):
                        return True
                    held[b] -= lengths[k]
                if held[b] == 0:
                    break
            return False

        if place(0):
            return n
    return 0


def test_bounds_never_exceed_the_optimum():
    rng = random.Random(6)
    for _ in range(150):
        lengths = sorted((rng.randint(1, 20) for _ in range(rng.randint(1, 9))), reverse=True)
        best = best_bins(lengths, 20)
        bins, _, held = packing.best_fit_decreasing(np.array(lengths), 20)
        assert packing.lower_bound(np.array(lengths), 20) <= best <= len(held) and held.max() <= 20 and bins.max() + 1 == len(held)


@pytest.mark.parametrize("group", [4000, 100])
def test_packing_round_trip(spark, group):
    docs = common.table(spark, SF, "documents")
    out = packing.pack(docs, group_pieces=group).toPandas()
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    for i, own in out.sort_values("piece").groupby("doc_id"):
        data = packing.ids_bytes(texts[i]) + (1).to_bytes(4, "little")
        assert own["length"].sum() == len(data) // 4 and (own["length"].iloc[:-1] == 4096).all()
        assert all(zlib.crc32(data[4 * p.start : 4 * (p.start + p.length)]) == p.ids_crc32 for p in own.itertuples())
    for _, own in out.sort_values("offset").groupby("sequence_id"):
        assert own["length"].sum() <= 4096 and (own["offset"].to_numpy() == np.concatenate([[0], np.cumsum(own["length"])[:-1]])).all()
    assert set(out["doc_id"]) == set(texts) and out["sequence_id"].nunique() <= packing.lower_bound(out["length"].to_numpy(), 4096) * 1.01 + 1
    proof = packing.certificate(spark.createDataFrame(out[["length", "sequence_id"]]))
    assert proof == {"sequences": out["sequence_id"].nunique(), "bound": packing.lower_bound(out["length"].to_numpy(), 4096)}


def test_the_last_group_is_repacked():
    rng = np.random.default_rng(1)
    better = 0
    for _ in range(20):
        lengths = rng.integers(60, 400, 120)
        bound = packing.lower_bound(lengths, 1000)
        bins, offsets, held = packing.exchange(lengths, 1000, bound)
        first = len(packing.best_fit_decreasing(lengths, 1000)[2])
        better += len(held) < first
        assert len(held) <= first and (np.bincount(bins, lengths) == held).all() and held.max() <= 1000
        for b in range(len(held)):
            own = np.flatnonzero(bins == b)[np.argsort(offsets[bins == b])]
            assert (offsets[own] == np.concatenate([[0], np.cumsum(lengths[own])[:-1]])).all()


# 10 -----------------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("seed", [1, 2])
def test_mtree_is_exact(spark, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 8))
    v = centres[rng.integers(0, 6, 3000)] + 0.1 * rng.normal(size=(3000, 8))
    v[100:400] = v[0]  # one vector often
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in mtree.top_k(docs).collect()}
    ints = np.floor(256 * v).astype(np.int64)
    for q in range(0, 3000, 50):
        s = ints @ ints[q]
        order = [i for i in np.lexsort((np.arange(3000), -s)) if i != q][:5]
        assert [got[q, k + 1] for k in range(5)] == [(int(i), int(s[i])) for i in order]
    assert len(got) == 300


def test_mtree_of_repeated_rows_and_wide_integers(spark):
    rng = np.random.default_rng(5)
    for scale in (1.0, 2.0**20):
        v = np.round(rng.normal(size=(120, 6)) * 64) / 64 * scale
        ids = [k // 2 for k in range(120)]  # every vec_id twice
        v[1:40:2] = v[0:40:2]
        docs = spark.createDataFrame([(i, x) for i, x in zip(ids, v.tolist(), strict=True)], "vec_id long, embedding array<double>")
        got = Counter(tuple(r) for r in mtree.top_k(docs, every=10).select("query_id", "rank", "vec_id", "score").collect())
        ints = [[int(math.floor(256 * x)) for x in row] for row in v.tolist()]
        want = Counter()
        for q in range(120):
            if ids[q] % 10 == 0:
                found = sorted((-sum(a * b for a, b in zip(ints[q], ints[c], strict=True)), ids[c]) for c in range(120) if c != q)[:5]
                want.update((ids[q], k + 1, i, -s) for k, (s, i) in enumerate(found))
        assert got == want
    with pytest.raises(ValueError, match="64-bit"):
        mtree.top_k(spark.createDataFrame([(0, [1e8]), (1, [1.0])], "vec_id long, embedding array<double>"))


def written_bytes(spark):
    """By stage: bytes that its tasks wrote, to tables and for shuffles."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return {(s.stageId(), s.attemptId()): s.outputBytes() + s.shuffleWriteBytes() for s in (stages.apply(i) for i in range(stages.size()))}


def test_mtree_sends_a_query_to_groups_not_to_trees(spark, monkeypatch):
    """One copy of a query's vector for each of many trees exhausted the executors' memory."""
    monkeypatch.setattr(mtree, "TREE", 32)  # 250 trees and more
    rng = np.random.default_rng(8)
    v = rng.normal(size=(8000, 32))
    v /= np.sqrt((v * v).sum(1))[:, None]  # bounds leave most trees to each query
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>")
    before = written_bytes(spark)
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in mtree.top_k(docs, every=4).collect()}
    grown = sum(b for stage, b in written_bytes(spark).items() if stage not in before)
    ints = np.floor(256 * v).astype(np.int64)
    for q in range(0, 8000, 4):
        s = ints @ ints[q]
        s[q] = -(2**62)
        order = np.lexsort((np.arange(8000), -s))[:5]
        assert [got[q, k + 1] for k in range(5)] == [(int(i), int(s[i])) for i in order]
    assert len(got) == 10_000
    # eight times all vectors as 64-bit integers; 2000 queries for each of 250 trees as 64-bit floats are 128 MB
    assert grown < 8 * ints.nbytes, grown


def test_mtree_integers_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, -0.001]), (1, None), (2, [1.0, None]), (3, [nan]), (4, [-inf, 1.0]), (5, []), (None, [1.0]), (6, [3.0, 1e6, 1.0]), (7, [1e308, 1.0])]
    for kind in ("double", "float"):
        docs = spark.createDataFrame(rows[: 9 if kind == "double" else 8], f"vec_id long, embedding array<{kind}>").coalesce(1)
        got = {r["vec_id"]: (np.frombuffer(r["v"], np.int32).tolist(), r["size"], r["square"]) for r in mtree.integers(docs).collect()}
        assert set(got) == {0, 5, 6} | ({7} if kind == "double" else set())
        assert got[0] == ([128, -1], 2, 16385.0) and got[5] == ([], 0, 0.0) and got[6] == ([768, 256_000_000, 256], 3, 256e6**2 + 768**2 + 256**2)
    assert got.get(7) is None or got[7][2] == inf
    assert mtree.top_k(docs.where("vec_id = 5"), every=5).count() == 0
    with pytest.raises(ValueError, match="64-bit"):
        mtree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
