import hashlib
import html
import random
import re
import time
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from packloom.llm import chat, decontamination, exact_dedup, html_extraction, line_dedup, ngram_join, registry, secrets, sentencepiece_codec, substring_dedup, toxicity
from packloom.llm.common import SPACED, text_bytes, word_hashes, words_of

SF = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [(1, "One two Three\nfour five six seven"), (2, "one TWO three\nfour five six seven"), (3, ""), (4, None), (5, "x" * 70_000), (6, "X" * 70_000), (7, "é É ▁ \x00"), (None, "one two three"), (8, "same"), (8, "same"), (8, "other")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, long texts, repeats and columns whose names the operators use themselves."""
    rows = [(i, t, "r", 1, "b") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, row string, body int, key string")


def read(sf, name):
    return duckdb.sql(f"select * from '{sf}/{name}.parquet'").fetchall()


def words(text, pattern=r"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, text or "")


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = registry.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = con.sql(f"select {', '.join(columns)} from ({registry.ORACLE_SQL[name]})").fetchall()
    assert sorted(str(tuple(r)) for r in got.select(*columns).collect()) == sorted(map(str, want))


# ---- exact dedup


def test_exact_dedup_odd_rows(spark, odd):
    rows = exact_dedup.exact_dedup(odd, first_digit=2, growth=3).collect()
    groups = Counter((t or "").translate(LOW) for _, t in ODD)
    assert len(rows) == len(ODD) and Counter(r.group_size for r in rows) == Counter(groups[(t or "").translate(LOW)] for _, t in ODD)
    by_id = {r.doc_id: r for r in rows if r.doc_id != 8}
    assert (by_id[1].keep_id, by_id[3].keep_id, by_id[5].keep_id) == (2, 4, 6) and by_id[2].kept and not by_id[1].kept and by_id[None].kept
    assert by_id[1].text_sha256 == hashlib.sha256(ODD[0][1].lower().encode()).hexdigest()
    assert exact_dedup.exact_dedup(odd.limit(0)).count() == 0


# ---- secrets


def brute_secrets(text):
    kinds = ((r"(password|passwd|secret|token|api_?key)", True), (r"AKIA[A-Z0-9]+", False), (r"[0-9a-f]+", False))
    assign = re.compile(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
    out = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(kinds[1][0], text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(kinds[2][0], text) if len(m[0]) >= 24]
    return sorted(out)


def test_secrets_against_brute_force(spark):
    rng = random.Random(1)
    parts = ["password", "PassWD", "token", "secret", "api_key", "APIKEY", "=", ":", " ", "'", '"', "abc", "ABCDEF", "AKIA", "AKIA" + "Q" * 16, "0123456789abcdef" * 2, "é🙂", "\n", "x" * 5, "=token=abcdef", "Zz9" * 8]
    texts = [None, "", *("".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(300))]
    df = spark.createDataFrame([(i, t, f"s{i % 3}") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    from pyspark.sql import functions as F

    rows = {r.doc_id: r for r in secrets.scan_secrets(df, F.col("source"), F.col("source")).collect()}
    for i, t in enumerate(texts):
        assert [(m["start"], m["kind"], m["end"]) for m in rows[i].base] == brute_secrets(t or ""), t


def test_secrets_of_one_owner_are_live(spark):
    from pyspark.sql import functions as F

    token, copied = "Ab3" * 8, "Zz9" * 8
    df = spark.createDataFrame([(1, f"x {token} {copied}", "a"), (2, f"y {copied}", "b"), (3, f"z {token}", "a"), (3, f"z {token}", None)], "doc_id long, text string, source string")
    rows = secrets.scan_secrets(df.filter("source is not null"), F.col("source"), F.col("source")).collect()
    assert sorted((r.doc_id, len(r.spans)) for r in rows) == [(1, 1), (2, 0), (3, 1)]
    assert secrets.scan_secrets(df, F.col("source"), F.col("source")).count() == 4
    assert secrets.scan_secrets(df.limit(0), F.col("source"), F.col("source")).count() == 0


def test_secrets_of_long_texts_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    text = " ".join(f"token=abc{k:06d} plain words " for k in range(1500)) + "x" * 300_000
    df = spark.createDataFrame([(1, text, "a", "v"), (2, None, "a", "v"), (None, "password: hunter22", "b", "v")], "doc_id long, text string, source string, value string")
    rows = {r.doc_id: r for r in secrets.scan_secrets(df.withColumns({"hit": F.lit(1), "base": F.lit(2), "kind": F.lit(3)}), F.col("source"), F.col("source")).collect()}
    assert [(m["start"], m["kind"], m["end"]) for m in rows[1].base] == brute_secrets(text) and len(rows[1].base) == 1500
    assert list(rows[2].base) == [] and len(rows[None].base) == 1


# ---- n-gram join


def brute_components(docs, size=5):
    sets = {}
    for i, t in docs:
        w = words((t or "").translate(LOW))
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("rare, paired", [(64, 12), (2, 12), (2, 1)])
def test_ngram_components_against_brute_force(spark, rare, paired):
    rng = random.Random(rare + paired)
    vocabulary = [f"w{k}" for k in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    docs = []
    for family in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, 60))] + (passage if family % 2 else [])
        for _ in range(rng.randint(1, 14)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            docs.append((len(docs), " ".join(copy)))
    docs += [(len(docs), ""), (len(docs) + 1, None), (len(docs) + 2, "  \n"), (len(docs) + 3, "a B"), (len(docs) + 4, "A b")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(spark.createDataFrame(docs, "doc_id long, text string"), rare=rare, paired=paired).collect()}
    assert got == brute_components(docs)


def test_ngram_odd_rows(spark, odd):
    rows = ngram_join.ngram_components(odd).collect()
    assert len(rows) == len(ODD) and {r.doc_id: r.component_id for r in rows if r.doc_id in (1, 2, 3, 4)} == {1: 1, 2: 1, 3: 3, 4: 4}
    base = [f"w{k}" for k in range(60)]
    near = lambda n: " ".join(base[n : n + 50])
    rows = [(1, near(0)), (None, near(5)), (9, near(10)), (None, near(5)), (None, "alone with a null id"), (None, None)]
    got = [(r.doc_id, r.component_id) for r in ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted([(1, 1), (9, 1), (None, 1), (None, 1), (None, None), (None, None)], key=str)
    assert ngram_join.ngram_components(odd.limit(0)).count() == 0


def passage_corpus(n):
    """Texts of 8 passages out of 30, of which no two link: each passage's words are frequent."""
    rng = random.Random(7)
    passages = [" ".join(f"p{k}w{i}" for i in range(rng.randint(20, 40))) for k in range(30)]
    return [(i, " ".join(passages[k] for k in rng.sample(range(30), 8))) for i in range(n)]


def test_ngram_combinations_spare_pairs_of_frequent_passages(spark, monkeypatch):
    untested, shares = ngram_join._untested, []
    for n in (150, 300, 600):
        tested = []
        monkeypatch.setattr(ngram_join, "_untested", lambda *a, to=tested: (lambda out: (to.append(out.count()), out)[1])(untested(*a)))
        docs = passage_corpus(n)
        docs += [(n, docs[5][1] + " one more"), (n + 1, "zero " + docs[5][1])]
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(spark.createDataFrame(docs, "doc_id long, text string"), rare=2).collect()}
        assert got[n][1] == got[n + 1][1] == 5
        if n == 150:
            assert got == brute_components(docs)
        shares.append(sum(tested) / (n * (n + 1) / 2))
    assert shares[0] > shares[1] > shares[2] and shares[2] < 0.05, shares


def test_ngram_choices_hold_the_first_common_classes():
    rng = random.Random(3)
    for _ in range(500):
        weight = [rng.randint(1, 9) for _ in range(rng.randint(1, 9))]
        spare, size = rng.randint(0, 12), rng.choice((2, 4))
        shared = [i for i in range(len(weight)) if rng.random() < 0.8]
        found = ngram_join._choices(weight, 0, spare, size, 10**9)
        head = tuple(shared[:size])
        lacks = sum(w for i, w in enumerate(weight) if i not in shared and (len(head) < size or i < head[-1]))
        assert not head or ((lacks, head) in found) == (lacks <= spare)
        assert len({x for _, x in found}) == len(found) and (ngram_join._choices(weight, 0, spare, size, len(found) - 1) is None or not found)


# ---- line dedup


def test_patience_blocks():
    a, b = [1, 3, 5, 7, 9, 11, 5], [3, 5, 8, 7, 9, 2]
    blocks = line_dedup.patience_blocks(a, b)
    assert blocks == [(1, 0, 2), (3, 3, 2)]
    rng = random.Random(2)
    for _ in range(200):
        x, y = ([rng.randrange(1, 12) for _ in range(rng.randrange(0, 20))] for _ in range(2))
        at = (0, 0)
        for s, t, n in line_dedup.patience_blocks(x, y):
            assert s >= at[0] and t >= at[1] and n > 0 and x[s : s + n] == y[t : t + n]
            at = (s + n, t + n)


def line_keys(lines, least=20):
    """(start, past) of long lines, and of runs of shorter ones that reach the size together."""
    size = [len(x.encode()) for x in lines]
    for i, n in enumerate(size):
        past, total = i, 0
        while n and past < len(lines) and total < least and (past == i or size[past] < least):
            total, past = total + size[past], past + 1
        if total >= least:
            yield i, past


def brute_line_dedup(docs, least=20, rare=line_dedup.RARE):
    """Each document against the earlier holders of its keys: all of a rare key, else the first."""
    lines = {i: (t or "").split("\n") for i, t in docs}
    holders = defaultdict(set)
    for i, x in lines.items():
        for s, e in line_keys(x, least):
            holders[tuple(x[s:e])].add(i)
    number, out = {"": 0}, {}
    code = {i: [number.setdefault(y, len(number)) for y in x] for i, x in lines.items()}
    for i, t in docs:
        with_ = set()
        for s, e in line_keys(lines[i], least):
            of = holders[tuple(lines[i][s:e])]
            with_ |= {x for x in of if x < i} if len(of) <= rare else {min(of)} - {i}
        gone = set()
        for e in with_:
            gone |= line_dedup.common_lines(code[i], code[e], [len(x.encode()) for x in lines[i]], least)
        out[i] = ("\n".join(x for k, x in enumerate(lines[i]) if k not in gone) if gone else t, len(lines[i]), len(gone))
    return out


def check_line_rules(docs, got, least=20):
    """No key of an earlier document stays; what goes lies in a block that an earlier one has."""
    lines, seen = {i: (t or "").split("\n") for i, t in docs}, []
    for i in sorted(lines):
        x, left = lines[i], (got[i] or "").split("\n")
        earlier = {tuple(y[s:e]) for y in seen for s, e in line_keys(y, least)}
        assert not any(tuple(left[s:e]) in earlier for s, e in line_keys(left, least) if e == s + 1)
        blocks = {tuple(y[s:e]) for y in seen for s in range(len(y)) for e in range(s + 1, len(y) + 1)}
        allowed = set()
        for s in range(len(x)):
            for e in range(s + 1, len(x) + 1):
                if tuple(x[s:e]) in blocks and sum(len(z.encode()) for z in x[s:e]) >= least:
                    allowed.update(range(s, e))
        must = {k for s, e in line_keys(x, least) if tuple(x[s:e]) in earlier for k in range(s, e)}
        rest = iter(left)
        assert all(z in rest for z in [y for k, y in enumerate(x) if k not in allowed]) and len(left) <= max(1, len(x) - len(must))
        seen.append(x)


@pytest.mark.parametrize("rare", [4, 0])
def test_line_dedup_against_brute_force(spark, rare):
    rng = random.Random(3)
    pool = [f"a line that is long enough, number {k}" for k in range(40)] + ["short", "", "}", "so much depends"]
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 12)))) for i in range(60)] + [(60, None), (61, "")]
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup.line_dedup(spark.createDataFrame(docs, "doc_id long, text string"), rare=rare).collect()}
    assert got == brute_line_dedup(docs, rare=rare)
    check_line_rules(docs, {i: t for i, (t, _, _) in got.items()})


def test_line_dedup_odd_rows(spark, odd):
    rows = line_dedup.line_dedup(odd).collect()
    assert len(rows) == len(ODD) and all(r.row["row"] == "r" and r.row["body"] == 1 for r in rows)
    assert {r.text for r in rows if r.doc_id == 8} == {"same", "other"} and next(r.text for r in rows if r.doc_id == 4) is None
    assert line_dedup.line_dedup(odd.limit(0)).count() == 0


def kept_lines(spark, docs):
    return {r.doc_id: r.text.split("\n") for r in line_dedup.line_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}


def test_line_dedup_of_common_moved_and_repeated_lines(spark):
    common = "a line of the licence that most documents have"
    docs = [(0, f"{common}\nthe first one's own long line\n{common}"), *[(i, f"the own long line of document {i}\n{common}") for i in range(1, 12)]]
    got = kept_lines(spark, docs)
    assert got[0] == docs[0][1].split("\n") and not any(common in got[i] for i in range(1, 12))
    one, two = "the first of two lines of a block", "the second of two lines of a block"
    assert kept_lines(spark, [(1, f"{one}\n{two}\nown"), (2, f"{two}\nown words\n{one}\n{one}")])[2] == ["own words"]


def test_line_dedup_of_short_lines(spark):
    verse = ["so much", "depends", "upon", "a red wheel", "barrow"]
    docs = [(1, "\n".join(["one", *verse, "end"])), (2, "\n".join(["an own long line that comes first", *verse])), (3, "own\nupon\nthis"), (4, "\n".join(["so much", "rain", "here", *verse[2:]]))]
    assert kept_lines(spark, docs) == {1: ["one", *verse, "end"], 2: ["an own long line that comes first"], 3: ["own", "upon", "this"], 4: ["so much", "rain", "here"]}


# ---- words that a polynomial modulo 2 ** 64 takes for equal


def thue_morse(n, a, b):
    return [(a, b)[bin(i).count("1") % 2] for i in range(n)]


def test_words_of_thue_morse_letters_differ(spark):
    one, two = "".join(thue_morse(1024, "a", "b")), "".join(thue_morse(1024, "b", "a"))
    model = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=sentencepiece_codec.model_file())
    texts = [(1, f"{one} {two}"), (2, one), (3, two), (4, " ".join(thue_morse(2048, "x", "y"))), (5, " ".join(thue_morse(2048, "y", "x")))]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    for r in sentencepiece_codec.sentencepiece_codec(df, sentencepiece_codec.model_file()).collect():
        assert r.ids == model.encode(dict(texts)[r.doc_id], add_eos=True) and r.decoded == model.decode(r.ids)
    assert all(r.n_removed == 0 for r in line_dedup.line_dedup(df).filter("doc_id in (2, 3)").collect())
    assert {r.doc_id: r.component_id for r in ngram_join.ngram_components(df).collect()} == {i: c for i, (_, c) in brute_components(texts).items()}
    items = spark.createDataFrame([(1, one)], "item_id long, text string")
    assert {r.doc_id for r in decontamination.find_contamination(df, items).filter("size(spans) > 0").collect()} == {1, 2}
    got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in substring_dedup.substring_dedup(df).collect()}
    assert got == brute_substrings(texts)


# ---- SentencePiece


def test_codec_equals_the_library(spark, odd):
    sentencepiece = pytest.importorskip("sentencepiece")
    model = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.model_file())
    rng = random.Random(4)
    parts = [" ", "  ", "a", "the", "ing", "\n", "\t", "é", "日本", "▁", "🙂", "\x00", "aaaa", "====", "12", "<s>", "ﬁ", "　", "́", "\r\n", "한국"]
    texts = [None, "", " ", "a" * 3001, "ab" * 500, " " * 77, "日本" * 300, *("".join(rng.choice(parts) for _ in range(rng.randint(1, 60))) for _ in range(500))]
    rows = {r.doc_id: r for r in sentencepiece_codec.sentencepiece_codec(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), sentencepiece_codec.model_file()).collect()}
    for i, t in enumerate(texts):
        want = model.encode(t or "", add_eos=True)
        assert rows[i].ids == want and rows[i].decoded == model.decode(want), t
    assert sentencepiece_codec.sentencepiece_codec(odd, sentencepiece_codec.model_file()).count() == len(ODD)
    assert sentencepiece_codec.sentencepiece_codec(odd.limit(0), sentencepiece_codec.model_file()).count() == 0


# ---- decontamination


def brute_hits(text, items, n=10):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    w = words((text or "").translate(LOW), pattern)
    hit, found = set(), set()
    for name, item in items:
        v = words((item or "").translate(LOW), pattern)
        k = min(n, len(v))
        for s in range(len(v) - k + 1) if v else ():
            for i in range(len(w) - k + 1):
                if w[i : i + k] == v[s : s + k]:
                    hit.update(range(i, i + k))
                    found.add(str(name))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("shard_bytes, piece, stretch", [(1 << 20, 5000, 256), (200, 12, 3)])
def test_contamination_against_brute_force(spark, monkeypatch, shard_bytes, piece, stretch):
    monkeypatch.setattr(decontamination, "PIECE_WORDS", piece)
    monkeypatch.setattr(decontamination, "STRETCH_WORDS", stretch)
    rng = random.Random(6)
    vocabulary = ["a", "b", "c", "É", "x9", "d-e"]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice((0, 1, 3, 8, 12, 30))))) for k in range(12)] + [(99, None), (3, "b b b b b b b b b b b"), (None, "zz yy")]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))) for i in range(60)]
    docs = [(i, f"{t}, {items[rng.randrange(12)][1]}! {t}") if i % 3 == 0 else (i, t) for i, t in docs] + [(60, None), (61, "zz YY")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    rows = {r.doc_id: r for r in decontamination.find_contamination(d, b, shard_bytes=shard_bytes).collect()}
    named = [("" if k is None else k, t) for k, t in items]
    for i, t in docs:
        assert (rows[i].n_words, sum(s.end - s.start for s in rows[i].spans), list(rows[i]["items"])) == brute_hits(t, named), t


@pytest.mark.parametrize("block_bytes", [1, 20_000])
def test_contamination_in_blocks_equals_one_pass(spark, odd, block_bytes):
    """More automata than one pass may broadcast: a pass for each block, merged by the last."""
    rng = random.Random(8)
    vocabulary = ["a", "b", "c", "É", "x9", "d-e"]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice((1, 3, 8, 12, 30))))) for k in range(20)] + [(99, None), (None, "one two")]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))) for i in range(40)]
    docs = [(i, f"{t}, {items[rng.randrange(20)][1]}! {t} {items[rng.randrange(20)][1]}") for i, t in docs]
    docs += [docs[3], docs[3], (3, "other words " + items[2][1]), (None, items[1][1]), (None, items[1][1]), (None, None), (50, "")]
    b = spark.createDataFrame(items, "item_id long, text string")
    for d in (spark.createDataFrame([(*x, "s", "i") for x in docs], "doc_id long, text string, spans string, _id string"), odd, odd.limit(0)):
        one, many = (sorted(map(str, decontamination.find_contamination(d, b, shard_bytes=100, block_bytes=n).collect())) for n in (1 << 26, block_bytes))
        assert one == many and len(one) == d.count()
    named = [("" if k is None else k, t) for k, t in items]
    rows = decontamination.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), b, shard_bytes=100, block_bytes=block_bytes).collect()
    assert all((r.n_words, sum(s.end - s.start for s in r.spans), list(r["items"])) == brute_hits(r.text, named) for r in rows) and len(rows) == len(docs)


def test_decontaminate_cuts_spans_and_keeps_clean_texts(spark, odd):
    item = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, f"Before, this. {item.upper()}! After that {'word ' * 12}"), (2, item), (3, "Clean  text.\n"), (4, None)], "doc_id long, text string")
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = {r.doc_id: r.text for r in decontamination.decontaminate(docs, b).collect()}
    assert rows == {1: f"Before, this. ! After that {'word ' * 12}", 3: "Clean  text.\n", 4: None}
    assert decontamination.find_contamination(odd, b.limit(0)).filter("size(spans) > 0").count() == 0
    assert decontamination.find_contamination(odd.limit(0), b).count() == 0


# ---- chats


def test_chats_are_linked_and_ordered(spark):
    rows = [
        (1, 0, "user", "Hello there friend\nhow are you?"), (1, 1, "assistant", "> hello   there friend\nI am fine"), (1, 2, "user", "second\nthread"),
        (1, 3, "assistant", "On Monday X wrote:\n> I am fine\n>> Hello there friend\n\ngood to hear"), (1, 4, "user", "> second\n> thread\nok"), (1, 5, None, None), (1, None, "user", "x"), (None, 0, "user", "a"), (2, 0, "user", "> unknown\nhi"),
    ]
    df = spark.createDataFrame([(*r, "p") for r in rows], "conv_id long, turn long, role string, text string, path string")
    got = {(r.conv_id, r.part): r for r in chat.format_chats(df, part_messages=4).collect()}
    assert (got[1, 0].turns, got[1, 0].parents, got[1, 1].turns, got[1, 1].parents) == ("0,1,3,2", "-,0,1,-", "4,5,-", "2,-,-")
    assert got[1, 0].text.startswith("<|user|>\nHello there friend\nhow are you?\n<|end|>\n<|assistant|>\nI am fine\n<|end|>") and "wrote" not in got[1, 0].text and ">" not in got[2, 0].text.replace("|>", "")
    assert got[None, 0].n_messages == 1 and "unknown" in got[1, 1].text
    assert chat.format_chats(df.limit(0)).count() == 0


def test_chats_are_linked_by_nested_quotes(spark):
    rows = [(0, "the first question"), (1, "another thread"), (2, "On Monday X wrote:\n> On Sunday Y wrote:\n> > the first question\nan answer"), (3, ">> another thread\nmore"), (4, "> an answer\n>> another thread\n>> the first question\nthanks"), (5, "> not in the table\n>>> the first question\nlast")]
    df = spark.createDataFrame([(1, t, "user", x) for t, x in rows], "conv_id long, turn long, role string, text string")
    assert {r.turn: r.parent for r in chat.link_quotations(df).collect()} == {0: None, 1: None, 2: 0, 3: 1, 4: 2, 5: 0}


def test_chats_are_linear_in_lines(spark):
    """Messages of many lines, all different, quoted whole; repeated lines count once."""
    lines = [f"line {k} of it" for k in range(40_000)]
    rows = [(0, "\n".join(lines)), (1, "\n".join("> " + x for x in lines) + "\nyes"), (2, "short\nshort"), (3, "> short\n> short\n> short\n> line 7 of it\nno")]
    df = spark.createDataFrame([(1, t, "user", x) for t, x in rows], "conv_id long, turn long, role string, text string")
    began = time.time()
    assert {r.turn: r.parent for r in chat.link_quotations(df).select("turn", "parent").collect()} == {0: None, 1: 0, 2: None, 3: 0}
    assert time.time() - began < 30


def brute_chats(rows):
    """Parents and reply order of one conversation's (turn, text) rows."""
    normal = lambda x: " ".join(x.lower().split())
    parsed = {}
    for turn, text in rows:
        runs = []
        for line in text.split("\n"):
            marks = re.match(r"[ \t]*((?:>[ \t]?)+)", line)
            level, body = (marks[1].count(">"), line[marks.end() :]) if marks else (0, line)
            if not runs or runs[-1][0] != level:
                runs.append((level, []))
            runs[-1][1].append(body)
        units = {(level, normal(u)) for level, lines in runs for u in [" ".join(lines), *lines]}
        parsed[turn] = [u for u in units if u[1]]
    first = {}
    for turn in sorted(parsed):
        for level, u in parsed[turn]:
            if level == 0:
                first.setdefault(u, turn)
    parent = {}
    for turn, units in parsed.items():
        votes = Counter()
        for level, u in units:
            if level and first.get(u, turn) < turn:
                votes[level, first[u]] += len(u)
        best = max(votes, key=lambda v: (-v[0], votes[v], v[1]), default=None)
        parent[turn] = best and best[1]
    order = []

    def walk(turn):
        order.append(turn)
        for t in sorted(t for t, p in parent.items() if p == turn):
            walk(t)

    for t in sorted(t for t, p in parent.items() if p is None):
        walk(t)
    return order, parent


def test_chats_against_brute_force(spark):
    rng = random.Random(12)
    pool = [f"some words of message {k}" for k in range(40)]
    rows, want = [], {}
    for conv in range(8):
        mine = []
        for turn in range(rng.randint(1, 30)):
            lines = []
            for _ in range(rng.randint(0, 3)):
                lines.append("> " * rng.randint(1, 3) + rng.choice(pool))
            lines += [rng.choice(pool) for _ in range(rng.randint(0, 2))]
            mine.append((turn, "\n".join(lines)))
        want[conv] = brute_chats(mine)
        rows += [(conv, t, "user", x) for t, x in mine]
    # A chain of answers, each to the one before.
    chain = [(t, f"> message {t - 1} of the chain\nmessage {t} of the chain") for t in range(70)]
    want[99] = brute_chats(chain)
    rows += [(99, t, "user", x) for t, x in chain]
    got = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    for conv, (order, parent) in want.items():
        assert got[conv].turns == ",".join(map(str, order)) and got[conv].parents == ",".join("-" if parent[t] is None else str(parent[t]) for t in order)


def test_chats_with_a_very_long_text(spark):
    text = "\n".join(f"{'> ' * (k % 2)}line {k}" for k in range(20_000))
    rows = [(1, 0, "user", "line 1", "x"), (1, 1, "user", text, "y")]
    (r,) = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, position string")).collect()
    assert (r.turns, r.parents) == ("0,1", "-,0") and r.text.count("\n") == 10_000 + 1 + 4


def test_chats_without_quotes_keep_their_order(spark):
    rows = read(SF, "conversations")
    got = chat.op7_chat_formatting(spark, SF).collect()
    want = defaultdict(list)
    for conv, turn, role, text in sorted(rows):
        want[conv].append(f"<|{role}|>\n{(text or '').strip(chr(10) + ' ')}\n<|end|>\n")
    assert {r.conv_id: r.text for r in got} == {c: "".join(x) for c, x in want.items()}


# ---- toxicity


def test_toxicity_on_held_out_labels(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    chain = toxicity.fit_chain(docs, labels.filter("doc_id % 4 <> 0"), toxicity.TARGETS)
    scored = toxicity.score_chain(docs, chain).join(labels.filter("doc_id % 4 = 0"), "doc_id").select("toxic", (toxicity.F.col("p")[1] >= 0.5).alias("said"))
    n = {(r.toxic, r.said): r["count"] for r in scored.groupBy("toxic", "said").count().collect()}
    # A part of the toxic labels of this table is noise: those texts hold no toxic word at all.
    assert n[1, True] / (n[1, True] + n.get((1, False), 0)) >= 0.7 and n.get((0, True), 0) / n[0, False] <= 0.01


def test_toxicity_odd_rows(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    chain = toxicity.fit_chain(odd, none, toxicity.TARGETS)
    rows = toxicity.score_chain(odd, chain).collect()
    assert len(rows) == len(ODD) and all(max(r.p) < 0.01 for r in rows)
    one_class = spark.createDataFrame([(1, 1, 0), (2, None, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.score_chain(odd, toxicity.fit_chain(odd, one_class, toxicity.TARGETS)).filter("p[1] >= 0.5").count() == 0


# ---- substring dedup


def brute_substrings(docs, n=35):
    seen = Counter()
    for _, t in docs:
        w = words(t)
        seen.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = {}
    for i, t in docs:
        w = words(t)
        gone = {j for s in range(len(w) - n + 1) if seen[tuple(w[s : s + n])] > 1 for j in range(s, s + n)}
        out[i] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_substrings_against_brute_force(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range((3, 30, 400)[seed])]
    passages = [[rng.choice(vocabulary) for _ in range(k)] for k in (33, 34, 35, 36, 50, 90, 300)] + [["a"] * 60, ["a", "b"] * 30, ["a", "a", "b"] * 20, ["a"] * 35]
    docs = []
    for i in range(70):
        text = []
        for _ in range(rng.randint(0, 3)):
            text += [rng.choice(vocabulary) for _ in range(rng.randint(0, 40))]
            passage = rng.choice(passages) if rng.random() < 0.6 else []
            first = rng.randrange(len(passage)) if len(passage) > 60 and rng.random() < 0.5 else 0
            text += passage[first : first + rng.choice((40, 100, 400))]
        docs.append((i, " \n".join(text)))
    docs += [(70, docs[3][1]), (71, docs[3][1] + " x"), (72, None), (73, ""), (74, " ".join(["z"] * 34)), (75, " ".join(["z"] * 36))]
    got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in substring_dedup.substring_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_substrings(docs)


def test_equal_substrings_share_interior_symbols(spark):
    """After each round the symbols of a repeated passage, but a few at its ends, are the same in every
    document, and a symbol's words are the same wherever it stands."""
    rng = random.Random(4)
    say = lambda n: [f"w{rng.randrange(1000)}" for _ in range(n)]
    passage = say(400) + ["a", "b"] * 30 + say(100)
    texts = [say(30 + 7 * k) + passage + say(20) for k in range(5)]
    spots, syms = {}, {}
    for k, text in enumerate(texts):
        data, at = text_bytes(pa.array([" ".join(text)]))
        starts, ends, first = words_of(data, at, SPACED)
        w = word_hashes(data, starts, ends)
        spot, name, _ = substring_dedup.anchors(w, first, 35)
        spots[k], syms[k] = spot.tolist(), [int(x) for x in name.view(np.int64)]
    shared = {x for x, n in Counter(x for v in syms.values() for x in v).items() if n > 1}
    code = {x: i for i, x in enumerate(sorted(shared))}
    rows = [(k, [p for p, x in zip(spots[k], syms[k]) if x in code], [code[x] for x in syms[k] if x in code]) for k in range(5)]
    seqs = spark.createDataFrame([(k, p, p, x) for k, p, x in rows], "number long, at array<int>, last array<int>, sym array<long>")
    reach, counts = substring_dedup._reach(35), []
    for rounds in range(4):
        kept = substring_dedup.Stored(spark, "test")
        got = {r.number: r for r in substring_dedup._named_rounds(kept.put(seqs), kept, reach, rounds).collect()}
        inside, words_of_symbol = [], {}
        for k, r in got.items():
            offset = 30 + 7 * k
            for a, z, x in zip(r["at"], r["last"], r["sym"]):
                covered = tuple(texts[k][a - 9 : z - 9 + reach])
                assert words_of_symbol.setdefault(x, covered) == covered
            inside.append([(a - offset, z - offset, x) for a, z, x in zip(r["at"], r["last"], r["sym"]) if 150 <= a - offset and z - offset <= 380])
        common = set.intersection(*map(set, inside))
        assert len(common) >= len(inside[0]) - 2
        counts.append(len(inside[0]))
    assert counts[3] < counts[2] < counts[1] < counts[0]


def test_every_window_holds_a_symbol():
    rng = random.Random(9)
    for trial in range(60):
        text = [rng.choice("ab" if trial % 2 else "abcdefgh") for _ in range(120)]
        at = np.array([0, 120])
        code = np.array([hash(("s", c)) & (2**64 - 1) for c in text], np.uint64)
        spot, _, _ = substring_dedup.anchors(code, at, 35)
        assert all(any(s + 9 <= x <= s + 22 for x in spot) for s in range(86))


def test_substrings_odd_rows(spark, odd):
    rows = substring_dedup.substring_dedup(odd).collect()
    assert len(rows) == len(ODD) and all(r.n_removed == 0 and r.row["key"] == "b" for r in rows)
    assert substring_dedup.substring_dedup(odd.limit(0)).count() == 0


# ---- HTML


def test_main_text_of_the_pages():
    for _, _, page in read(SF, "pages"):
        article = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", p.replace("<br>", " "))).split()) for p in re.split(r"</?(?:p|h1)>", article)]
        assert html_extraction.main_text(page) == "\n".join(p for p in parts if p)


def test_main_text_of_other_layouts(spark):
    long = "A sentence of the article that goes on for a while, so that it is text. " * 3
    page = f"<body><header>Top</header><div id=menu-main><a>x</a></div><div class='content'><h2>Title</h2><p>{long}</p><p>Short.</p><ul><li>one<li>two</ul><p>{long}&amp;&nbsp;&eacute;</p></div><aside>{long}</aside><section class='comments'><p>{long}</p></section><footer>{long}</footer><script>var a='<p>{long}</p>'</script></body>"
    want = [" ".join(x.split()) for x in ("Title", long, "Short.", "one", "two", long + "&\xa0é")]
    assert html_extraction.main_text(page) == "\n".join(want)
    assert [html_extraction.main_text(x) for x in (None, "", "<p>", "<nav>a</nav>", "plain  text")] == ["", "", "", "", "plain text"]
    df = spark.createDataFrame([(1, "u", page, "t"), (1, None, None, "t"), (None, "u", "<p>a</p>", "t")], "page_id long, url string, html string, text string")
    assert html_extraction.extract_main_text(df).count() == 3 and html_extraction.extract_main_text(df.limit(0)).count() == 0


def test_main_text_is_not_lost_to_names():
    long = "A sentence of the article that goes on for a while, so that it is text. " * 3
    text = f"<h1>Title</h1><p>{long}</p><p>Short.</p><p>{long}</p>"
    want = "\n".join(["Title", long.strip(), "Short.", long.strip()])
    assert html_extraction.main_text(f"<body><form id=aspnetForm><div>{text}</div></form></body>") == want
    assert html_extraction.main_text(f"<body><nav>a</nav><div class=social>{text}</div><footer>b</footer></body>") == want
    assert html_extraction.main_text(f"<article><div class='entry-header'><h1>Title</h1></div><p>{long}</p><p>Short.</p><section id=related-work><p>{long}</p></section><div class=related><ul><li><a href=x>a</a><li><a href=y>b</a></ul></div></article>") == want
    assert html_extraction.main_text(f"<div id=page class=has-sidebar>{text}<div class=sidebar><p>{long}</p></div><div id=comments>{f'<p>{long}</p>' * 20}</div></div>") == want


def test_names_are_weak_votes():
    long = "A paragraph of the article, with several clauses, that goes on for a while so that it counts for something. " * 3
    p, want = f"<p>{long}</p>", long.strip()
    for page, blocks in (
        (f"<article><h1>Title</h1>{p}<div class='cookie-recipe'>{p}{p}</div><p>End.</p></article>", ["Title", want, want, want, "End."]),
        (f"<article><h1>Title</h1>{p}<section class=menu><h2>Dishes</h2>{p}{p}</section></article>", ["Title", want, "Dishes", want, want]),
        (f"<body><nav><a>x</a></nav><h1 class='page-header'>Title</h1>{p}{p}</body>", ["Title", want, want]),
        (f"<body><div class='page-header'><h1>Title</h1></div>{p}{p}</body>", ["Title", want, want]),
        (f"<body><article>{p}</article><article>{p}</article><article><h2>Short</h2></article></body>", [want, want]),
        (f"<article>{p}<div class=ad>{p}</div><div class=newsletter><p>{long}</p><form>x</form></div>{p}</article>", [want, want]),
        (f"<body><div class='main-menu'><ul><li><a>a</a><li><a>b</a></ul></div><div>{p}{p}</div></body>", [want, want]),
        (f"<article>{p}<p>a &lt; b</p></article><a href='x", [want, "a < b"]),
    ):
        assert html_extraction.main_text(page) == "\n".join(blocks), page


def test_hostile_pages_take_linear_time():
    for part, end in (("<a ", ""), ("<!--", ""), ("<a x='", ""), ("</", ""), ("<![", ""), ("<?", ""), ("<a =", ">"), ("<a b", ">"), ("&#", ""), ("<script><!--", ">-->"), ("<textarea>", "")):
        began = time.time()
        html_extraction.main_text(part * 100_000 + end)
        assert time.time() - began < 4, part

def test_main_text_of_deep_and_very_long_pages():
    import time

    began = time.time()
    assert html_extraction.main_text("<div>x" * 20_000).count("\n") == 19_999
    assert len(html_extraction.main_text(f"<p>{'word ' * 200_000}</p>")) == 999_999
    assert time.time() - began < 20


def brute_page(rng, long):
    """A page and the text of its article, from layouts that the operator doesn't know."""
    say = lambda n: " ".join(rng.choice(long) for _ in range(n))
    blocks = [("h1", say(4))] + [(rng.choice(("p", "p", "blockquote", "li")), say(rng.randint(12, 60))) for _ in range(rng.randint(4, 12))]
    article = "".join(f"<ul><li>{x}</li></ul>" if tag == "li" else f"<{tag}>{x.replace(' ', ' <b>x</b> ', 1).replace('<b>x</b> ', '')}</{tag}>" for tag, x in blocks)
    links = "".join(f"<li><a href='/{k}'>{rng.choice(long)}</a></li>" for k in range(6))
    before = rng.choice((f"<nav><ul>{links}</ul></nav>", f"<header><a>{say(2)}</a></header>", f"<div class='top-menu'><ul>{links}</ul></div>", f"<div class=cookie-notice>{say(20)}</div>"))
    after = rng.choice((f"<footer>{say(10)}</footer>", f"<aside><p>{say(30)}</p></aside>", f"<div id=comments><p>{say(40)}</p></div>", f"<div class='sponsored ad'><p>{say(25)}</p></div>", f"<form><label>{say(3)}</label><input></form>"))
    frame = rng.choice(("<article>{}</article>", "<main>{}</main>", "<div id=content>{}</div>", "<div class=post><div class=body>{}</div></div>"))
    return f"<html><head><title>{say(3)}</title><style>p {{}}</style></head><body>{before}{frame.format(article)}{after}<script>{say(50)}</script></body></html>", "\n".join(x for _, x in blocks)


def test_main_text_of_many_layouts():
    rng = random.Random(8)
    long = [f"word{k}" * rng.randint(1, 2) for k in range(200)]
    for _ in range(300):
        page, want = brute_page(rng, long)
        assert html_extraction.main_text(page) == want


# ---- shared


def test_words_and_hashes():
    texts = ["a b  c", None, "", " é\tb\n", "c", "x" * 5000]
    data, at = text_bytes(pa.array(texts))
    starts, ends, first = words_of(data, at, SPACED)
    got = [data[s:e].tobytes().decode() for s, e in zip(starts, ends, strict=True)]
    assert got == ["a", "b", "c", "é", "b", "c", "x" * 5000] and first.tolist() == [0, 3, 3, 3, 5, 6, 7]
    h = word_hashes(data, starts, ends)
    assert h[1] == h[4] and h[2] == h[5] and len(set(h.tolist())) == 5
