"""Ranked lexical search, Merkle manifest and quality classifier."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from packloom.llm import lexical_search, merkle_manifest, quality_classifier

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [(1, "One two Three\nfour"), (2, "one TWO three\nfour"), (3, ""), (4, None), (5, "one " * 30_000), (6, "x" * 70_000), (7, "é É ▁ \x00 one"), (None, "one two three"), (8, "one"), (8, "one"), (8, "two")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "m", 1, b"b", 2.0) for i, t in ODD], "doc_id long, text string, m string, size int, bag binary, score double")


# ---- lexical search


def terms(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(LOW))


def brute_search(docs, items, k):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    n, total = sum(1 for _, b in bags if b), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item in sorted({i for i, t in items if i is not None}):
        wanted = {w for i, t in items if i == item for w in terms(t)}
        found = []
        for i, b in bags:
            m = 50 + 50 * sum(b.values()) * n // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 20 * m)) for t in wanted if t in b)
            if score > 0:
                found.append((-score, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return out


def searched(*args, **more):
    return sorted(map(tuple, lexical_search.lexical_search(*args, **more).collect()))


def test_search_odd_rows(spark, odd):
    items = [(1, "One, two"), (1, "É one-two"), (2, None), (3, ""), (4, "nothing here"), (None, "one"), (5, "x" * 70_000)]
    df = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, term string")
    assert searched(odd, df, 4) == sorted(brute_search(ODD, items, 4))
    assert searched(odd, df, 4, block_bytes=30_000) == sorted(brute_search(ODD, items, 4))
    assert searched(odd.limit(0), df) == [] and searched(odd, df.limit(0)) == []


def test_search_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "CELLS", 64)
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice("abcdefghij") for _ in range(rng.randint(0, 5)))) for i in range(400)] + [(i, "a b, a") for i in range(1000, 1300)]
    rng.shuffle(docs)
    items = [(i, " ".join(rng.sample("abcdefghijk", rng.randint(1, 4)))) for i in range(12)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    assert searched(df, spark.createDataFrame(items, "item_id long, text string"), 20) == sorted(brute_search(docs, items, 20))


def test_words_that_share_a_fingerprint(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(lexical_search, "word_hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64))
    words = lexical_search.Vocabulary.of(np.array([0, 0, 1]), pa.array(["ab", "cd", "efg"]), 2)
    data = np.frombuffer(b"cd xy ab efg abc", np.uint8)
    starts, ends = np.array([0, 3, 6, 9, 13]), np.array([2, 5, 8, 12, 16])
    place, number = words.find(data, starts, ends)
    assert sorted(zip(place.tolist(), number.tolist(), strict=True)) == [(0, 1), (2, 0), (3, 2)]


# ---- Merkle manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_tree(nodes):
    """The root, and for each node its siblings (before, after) by level."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for path, i in zip(paths, at, strict=True):
            run = i // 3 * 3
            path.append(("".join(level[run:i]), "".join(level[i + 1 : run + 3])))
        level, at = [sha(*level[i : i + 3]) for i in range(0, len(level), 3)], [i // 3 for i in at]
    return level[0], paths


def brute_manifest(rows):
    """rows: (group, order, leaf); the result by place: leaf, subroot, root, path."""
    groups = {}
    for g, o, leaf in rows:
        groups.setdefault(g, []).append((o is not None, o or 0, leaf))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [brute_tree([x[2] for x in sorted(groups[g])]) for g in names]
    root, above = brute_tree([t[0] for t in trees])
    return sorted((leaf, t[0], root, tuple(path + up)) for g, t, up in zip(names, trees, above, strict=True) for (_, _, leaf), path in zip(sorted(groups[g]), t[1], strict=True))


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 800, None: 2, "": 1, "é": 243, "z": 244, "b": 9}, {f"s{i}": 1 + i % 4 for i in range(250)}])
def test_manifest_against_brute_force(spark, sizes):
    rng = random.Random(4)
    rows = [(g, o, sha(str(g), str(o))) for g, n in sizes.items() for o in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "group string, pos long, digest string").repartition(5)
    got = merkle_manifest.merkle_manifest(df, F.col("digest"), F.col("group"), [F.col("pos")], [F.col("pos").alias("n")])
    ends = got.select(merkle_manifest.folded(F.col("leaf"), F.col("path")).alias("f"), "root").distinct().collect()
    assert [r.f for r in ends] == [ends[0].root]
    assert sorted((r.leaf, r.subroot, r.root, tuple((x.before, x.after) for x in r.path)) for r in got.collect()) == brute_manifest(rows)


def test_manifest_odd_rows(spark, odd):
    leaf = merkle_manifest.digest(merkle_manifest.field(F.col("doc_id")), merkle_manifest.field(F.col("text")))
    code = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    got = merkle_manifest.merkle_manifest(odd, leaf, F.col("m"), [F.col("doc_id")], [F.col("doc_id")])
    want = brute_manifest([("m", i, sha(code(i), code(t))) for i, t in ODD])
    assert sorted((r.leaf, r.subroot, r.root, tuple((x.before, x.after) for x in r.path)) for r in got.collect()) == want
    assert merkle_manifest.merkle_manifest(odd.limit(0), leaf, F.col("m"), [F.col("doc_id")]).count() == 0


# ---- quality classifier


def test_quality_on_rows_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    net = quality_classifier.fit_quality(docs, spark.read.parquet(f"{sf}/labels.parquet"), F.col("quality"), steps=250)
    rows = quality_classifier.score_quality(docs, net).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 for r in rows)
    of = {r.doc_id: r.score for r in rows}
    truth = {i: y for i, y in duckdb.sql(f"select doc_id, quality from '{sf}/labels.parquet'").fetchall() if zlib.crc32(str(i).encode()) % 4 == 2}
    good, bad = ([of[i] for i in truth if truth[i] == y] for y in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.95, (len(good), len(bad))


def test_quality_gradient():
    rng = np.random.default_rng(0)
    net = quality_classifier.Network.start(rng)
    chunks, at, good = rng.integers(0, 257, (5, quality_classifier.CHUNK)).astype(np.int16), np.array([0, 2, 5]), np.array([1, 0], np.float32)

    def loss():
        found, _ = net.responses(chunks)
        sizes = np.diff(at)[:, None]
        z = net.log_odds(np.add.reduceat(found, at[:-1]) / sizes, np.maximum.reduceat(found, at[:-1])).astype(float)
        return float(np.mean(np.logaddexp(0, z) - good * z))

    for part, grad in zip(net.parts(), net.gradient(chunks, at, good), strict=True):
        flat, step = part.reshape(-1), 3e-3
        for i in np.argsort(-np.abs(grad).ravel())[:3]:
            old = flat[i]
            flat[i] = old + step
            up = loss()
            flat[i] = old - step
            down = loss()
            flat[i] = old
            assert (up - down) / (2 * step) == pytest.approx(grad.ravel()[i], rel=0.1, abs=1e-4)


def test_quality_covers_whole_texts():
    size = np.array([0, 1, 256, 257, 480, 481, 10_000])
    n, starts = quality_classifier.chunk_starts(size)
    at = np.append(0, np.cumsum(n))
    for i, s in enumerate(size):
        own = starts[at[i] : at[i + 1]]
        assert own[0] == 0 and own[-1] + quality_classifier.CHUNK >= s and (len(own) == 1 or own[-1] + quality_classifier.OVERLAP < s)
        assert (np.diff(own) == quality_classifier.CHUNK - quality_classifier.OVERLAP).all()


def test_quality_odd_rows(spark, odd, monkeypatch):
    labels = spark.createDataFrame([(i, q, 1) for i, q in ((1, 1), (2, 0), (5, 1), (6, 0), (8, 1), (8, 0), (None, 1), (7, None), (99, 1))], "doc_id long, quality int, id int")
    net = quality_classifier.fit_quality(odd, labels, F.col("quality"), steps=3)
    rows = quality_classifier.score_quality(odd, net).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    by_text = {}
    for (i, t), r in zip(ODD, rows, strict=True):
        assert r.doc_id == i and by_text.setdefault(t or "", r.score) == pytest.approx(r.score, abs=1e-6)
    assert quality_classifier.score_quality(odd.limit(0), net).count() == 0
    blank = quality_classifier.fit_quality(odd, labels.limit(0), F.col("quality"))
    assert all(0 <= r.score <= 1 for r in quality_classifier.score_quality(odd, blank).collect())
    monkeypatch.setattr(quality_classifier, "GROUP", 7)  # a long text is worked off in many groups
    again = quality_classifier.score_quality(odd, net).collect()
    assert [r.score for r in again] == pytest.approx([r.score for r in rows], abs=1e-5)


def test_time_grows_with_the_text():
    net = quality_classifier.Network.start(np.random.default_rng(1))
    began = time.time()
    net.responses(np.zeros((4096, quality_classifier.CHUNK), np.int16))
    assert time.time() - began < 5  # a megabyte
