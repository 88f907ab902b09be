"""Substring dedup by recompression: long repeats are found through shared symbols.

Tasks rewrite each document's words a little way on their own: a run of two equal words becomes one
symbol, then neighbouring symbols whose names fall on the two sides of a coin become one,
up to MOST_WORDS words. A boundary is decided by the few words around it: SIGHT words from either
end of a repeat on, its symbols are the same in all its occurrences. Of the interior symbols those
with locally least names go on, each as the stretch of words around it that any window
around it contains. Neighbouring stretches overlap, so the sequence of them holds every word.

From here on Spark names symbols in rounds. It counts stretches over the corpus, gives each
that occurs twice a global name, and drops the others, as no repeat holds them. A round then proposes
runs of one symbol and pairs of neighbours that a new coin chooses, with their distance; Spark
counts the proposals, names those that occur twice, and documents are rewritten with the names.
Equal substrings so get equal symbols inside. A shared symbol proves that all its words
repeat: windows in it need no look, but in one of its occurrences. The windows left, around
the ends of repeats, are compared with each other and with those by two independent
64-bit fingerprints of all their words.

Copies of a whole document (by a 128-bit digest of its words) are found first and take part once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACED, Stored, chunks_of, grown, mix, packed, ragged, run_hashes, table, text_bytes, word_hashes, words_of

WINDOW = 35
#: Words in a symbol at most, rounds of pairing, and how far into a repeat its ends are felt:
#: 3 words for a run (it and its neighbours), then a symbol of 2 words, then one of 4.
MOST_WORDS, ROUNDS, SIGHT = 4, 2, 9
LEAST_WINDOW = 2 * SIGHT + 2 * MOST_WORDS
#: Rounds of naming runs and pairs in Spark. More rounds prove more windows at once; none changes the result.
SPARK_ROUNDS = 5
BIG = np.uint64(0xFFFFFFFFFFFFFFFF)


def symbol_starts(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts (word numbers) and names of the last round's symbols. at: each text's first word."""
    n = len(words)
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    same = np.zeros(n + 2, bool)
    same[1:n] = (words[1:] == words[:-1]) & ~edge[1:n]
    starts_here = np.ones(n, bool)
    starts_here[same[:n] & ~np.append(False, same[: n - 1]) & ~same[1 : n + 1]] = False
    for k in range(ROUNDS + 1):
        starts = np.flatnonzero(starts_here)
        ends = np.append(starts[1:], n)
        names = run_hashes(words, starts, ends)
        if k == ROUNDS or len(starts) < 2:
            return starts, names
        side = (mix(names + np.uint64(k + 1)) & np.uint64(1)).astype(bool)
        joins = ~side[:-1] & side[1:] & ~edge[starts[1:]] & (ends[1:] - starts[:-1] <= MOST_WORDS)
        starts_here[starts[1:][joins]] = False
    raise AssertionError


def _slide(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum (or maximum) of x[i : i + width] at each i, by doubling."""
    pick, fill = (np.minimum, BIG) if least else (np.maximum, np.uint64(0))
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = pick(out, np.append(out[step:], np.full(min(step, len(out)), fill, np.uint64)))
        have += step
    return out


def anchors(words: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers and names of the exchanged symbols, and each text's first one.

    Symbols that start SIGHT to window - SIGHT - MOST_WORDS words into a window are the same
    wherever the window occurs, so the least of them is too: each window holds one."""
    n = len(words)
    span = window - 2 * SIGHT - MOST_WORDS + 1
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    starts, names = symbol_starts(words, at)
    rank = np.full(n, BIG)
    rank[starts] = np.minimum(mix(names), BIG - np.uint64(1))
    least = _slide(rank, span, True)
    best = _slide(np.append(np.zeros(span - 1, np.uint64), least)[: n + span - 1], span, False)[:n]
    row = np.searchsorted(at, starts, "right") - 1
    inside = (starts - SIGHT >= at[row]) & (starts - SIGHT + window - span + 1 <= at[row + 1])
    spot = starts[(best[starts] == rank[starts]) & inside]
    return spot, run_hashes(words, spot - SIGHT, spot - SIGHT + _reach(window)), np.searchsorted(spot, at)


def _reach(window: int) -> int:
    """Words of the stretch around an exchanged symbol, which begins SIGHT words before it."""
    return 2 * SIGHT + MOST_WORDS


def _read(part: np.ndarray, offsets: np.ndarray):
    starts, ends, at = words_of(part, offsets, SPACED)
    words = word_hashes(part, starts, ends)
    body = [xxhash.xxh3_128_digest(words[x:y].tobytes()) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return starts, ends, at, words, body


def _anchor_lists(window: int):
    def run(batches):
        for b in batches:
            data, offsets = text_bytes(b.column(2))
            for first, past in chunks_of(offsets):
                _, _, at, words, body = _read(data[offsets[first] : offsets[past]], offsets[first : past + 1] - offsets[first])
                spot, name, begin = anchors(words, at, window)
                check = run_hashes(mix(words), spot - SIGHT, spot - SIGHT + _reach(window))
                local = spot - np.repeat(at[:-1], np.diff(begin))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first, past - first), b.column(1).slice(first, past - first), pa.array(body, pa.binary()), pa.array(np.diff(at), pa.int64()), packed(name.view(np.int64), begin, pa.int64()), packed(check.view(np.int64), begin, pa.int64()), packed(local.astype(np.int32), begin, pa.int32())],
                    ["id", "text_key", "body", "n_words", "names", "checks", "spots"],
                )

    return run


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a column of lists of numbers, and where each row's begin."""
    at = column.offsets.to_numpy().astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), at - at[0]


def _propose(round_: int, runs: bool, reach: int):
    """Merges of neighbouring symbols: (number, i, n, left, right, gap), n symbols from the i-th on. Of a run
    `right` is less than 0 and says how many symbols it has; gap is the distance of neighbours."""

    def run(batches):
        for b in batches:
            number = b.column(0).to_numpy(zero_copy_only=False)
            (at, begin), (last, _), (sym, _) = (_flat(b.column(c)) for c in ("at", "last", "sym"))
            row = np.repeat(np.arange(len(number)), np.diff(begin))
            gap = at[1:].astype(np.int64) - last[:-1]
            near = (row[1:] == row[:-1]) & (gap <= reach)
            if runs:
                i, n, k = [], [], 0
                places = np.flatnonzero(near & (sym[1:] == sym[:-1])).tolist()
                while k < len(places):
                    past = k + 1
                    while past < len(places) and places[past] == places[past - 1] + 1 and gap[places[past]] == gap[places[k]]:
                        past += 1
                    i.append(places[k])
                    n.append(past - k + 1)
                    if past < len(places) and places[past] == places[past - 1] + 1:
                        past += 1  # its first symbol is this run's last one
                    k = past
                i, n = np.array(i, np.int64), np.array(n, np.int64)
                right = -n
            else:
                side = (mix(sym.view(np.uint64) + np.uint64(round_)) & np.uint64(1)).astype(bool)
                i = np.flatnonzero(near & ~side[:-1] & side[1:])
                n, right = np.full(len(i), 2), sym[i + 1]
            columns = [(number[row[i]], pa.int64()), (i - begin[row[i]], pa.int32()), (n, pa.int32()), (sym[i], pa.int64()), (right, pa.int64()), (gap[i], pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in columns], ["number", "i", "n", "left", "right", "gap"])

    return run


_MERGE = "array<struct<i:int,n:int,sym:long>>"
_SEQUENCE = "number long, at array<int>, last array<int>, sym array<long>"


def _apply(batches):
    """Sequences with their named merges."""
    for b in batches:
        (at, begin), (last, _), (sym, _) = (_flat(b.column(c)) for c in ("at", "last", "sym"))
        at, last, sym = at.copy(), last.copy(), sym.copy()
        merges = b.column("merges")
        counts = merges.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        items = merges.flatten()
        i, n, to = (items.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
        first = np.repeat(begin[:-1], counts) + i
        last[first], sym[first] = last[first + n - 1], to
        stays = np.ones(len(at), bool)
        stays[ragged(first + 1, n - 1)] = False
        per = np.append(0, np.cumsum(stays))[begin]
        yield pa.RecordBatch.from_arrays([b.column("number"), packed(at[stays], per, pa.int32()), packed(last[stays], per, pa.int32()), packed(sym[stays], per, pa.int64())], ["number", "at", "last", "sym"])


def _named_rounds(seqs: DataFrame, kept: Stored, reach: int, rounds: int = SPARK_ROUNDS) -> DataFrame:
    """Sequences of shared symbols after rounds of naming runs and pairs."""
    keys = ["left", "right", "gap"]
    for k in range(1, 2 * rounds + 1):
        found = kept.put(seqs.mapInArrow(_propose(k, k % 2 == 1, reach), "number long, i int, n int, left long, right long, gap int"))
        names = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
        names = kept.put(names.select(*keys, (F.lit(k << 55) + F.monotonically_increasing_id()).alias("sym")))
        if names.isEmpty():
            continue
        merges = found.join(grown(names), keys).groupBy("number").agg(F.collect_list(F.struct("i", "n", "sym")).cast(_MERGE).alias("merges"))  # a document's own
        old, seqs = seqs, kept.put(seqs.join(grown(merges), "number", "left").mapInArrow(_apply, _SEQUENCE))
        kept.drop(old, found, names)
    return seqs


def _windows(window: int):
    """The windows around each document's shared symbols, but those that a shared symbol proves, as its
    number, start and two fingerprints."""

    def run(batches):
        span = window - 2 * SIGHT - MOST_WORDS + 1
        for b in batches:
            data, offsets = text_bytes(b.column(0))
            number = b.column(1).to_numpy(zero_copy_only=False)
            (flat, begin), (skip, skip_at), (skip_to, _) = (_flat(b.column(k)) for k in (2, 3, 4))
            for first, past in chunks_of(offsets):
                part, part_at = data[offsets[first] : offsets[past]], offsets[first : past + 1] - offsets[first]
                word_starts, word_ends, at = words_of(part, part_at, SPACED)
                words = word_hashes(part, word_starts, word_ends)
                mine = flat[begin[first] : begin[past]].astype(np.int64)
                row = np.repeat(np.arange(past - first), np.diff(begin[first : past + 1]))
                lo = at[row] + mine - SIGHT - span + 1
                marks = np.zeros(len(words) + 1, np.int64)
                np.add.at(marks, np.maximum(lo, at[row]), 1)
                np.add.at(marks, np.maximum(np.minimum(lo + span, at[row + 1] - window + 1), np.maximum(lo, at[row])), -1)
                row = np.repeat(np.arange(past - first), np.diff(skip_at[first : past + 1]))
                proved = np.zeros(len(words) + 1, np.int64)
                np.add.at(proved, at[row] + skip[skip_at[first] : skip_at[past]], 1)
                np.add.at(proved, at[row] + skip_to[skip_at[first] : skip_at[past]], -1)
                start = np.flatnonzero((np.cumsum(marks)[:-1] > 0) & (np.cumsum(proved)[:-1] == 0))
                row = np.searchsorted(at, start, "right") - 1
                prints = [pa.array(run_hashes(w, start, start + window).view(np.int64), pa.int64()) for w in (words, word_hashes(part, word_starts, word_ends, 1))]
                yield pa.RecordBatch.from_arrays([pa.array(number[first:past][row], pa.int64()), pa.array((start - at[row]).astype(np.int32), pa.int32()), *prints], ["number", "start", "print", "check"])

    return run


def _with_body(batches):
    for b in batches:
        data, offsets = text_bytes(b.column(1))
        found = [x for f, p in chunks_of(offsets) for x in _read(data[offsets[f] : offsets[p]], offsets[f : p + 1] - offsets[f])[4]]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.binary())], [*b.schema.names, "body"])


def _remove(window: int):
    """Covered word ranges of each text, and the text's bytes without them."""

    def run(batches):
        for b in batches:
            data, offsets = text_bytes(b.column(1))
            starts_of, whole = b.column(3), b.column(4).to_pylist()
            (proved, proved_at), (proved_to, _) = _flat(b.column(5)), _flat(b.column(6))
            n_words, n_removed, kept = [], [], []
            for first, past in chunks_of(offsets):
                part = data[offsets[first] : offsets[past]]
                starts, ends, at = words_of(part, offsets[first : past + 1] - offsets[first], SPACED)
                for r in range(past - first):
                    a, z = int(at[r]), int(at[r + 1])
                    gone = np.zeros(z - a + 1, np.int64)
                    given = starts_of[first + r]
                    if whole[first + r] and z - a >= window:
                        gone[0] += 1
                    else:
                        at_word = given.values.to_numpy(zero_copy_only=False).astype(np.int64) if given.is_valid else np.zeros(0, np.int64)
                        here = slice(proved_at[first + r], proved_at[first + r + 1])
                        np.add.at(gone, np.append(at_word, proved[here]), 1)
                        np.add.at(gone, np.append(at_word + window, proved_to[here] - 1 + window), -1)
                    stays = np.cumsum(gone)[:-1] == 0
                    s, e = starts[a:z][stays], ends[a:z][stays]
                    kept.append(b" ".join(bytes(part[i:j]) for i, j in zip(s.tolist(), e.tolist(), strict=True)) if not stays.all() else _spaced(part, s, e))
                    n_words.append(z - a)
                    n_removed.append(int((~stays).sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([k.decode() for k in kept], pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), b.column(2)], ["doc_id", "text", "n_words", "n_removed", "row"])

    return run


def _spaced(part: np.ndarray, s: np.ndarray, e: np.ndarray) -> bytes:
    """Words with one space between them."""
    if not len(s):
        return b""
    size = e - s + 1
    out = np.append(part, np.uint8(0x20))[np.where(np.arange(size.sum()) + 1 == np.repeat(np.cumsum(size), size), len(part), ragged(s, size))]
    return out[:-1].tobytes()


def substring_dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, text (kept words joined by one space), n_words,
    n_removed, and row, a struct of the columns of `docs` but the text.

    Words part at ASCII white space. A word is removed if a window of `window` words that
    covers it also starts anywhere else, in the same document too (overlaps count); windows
    are those of the input. Null, empty and shorter texts have no window. Repeated rows are
    copies of each other. Rows of one id with different texts are different documents; a
    null id is an id like any other."""
    if window < LEAST_WINDOW:
        raise ValueError(f"window must be {LEAST_WINDOW} words at least")
    kept = Stored(docs.sparkSession, "substring-dedup")
    text = F.col(text_col)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_key"), text.alias("text"))
    read = kept.put(rows.mapInArrow(_anchor_lists(window), "id long, text_key long, body binary, n_words long, names array<long>, checks array<long>, spots array<int>"))
    # Each distinct word sequence takes part once, as one of its rows; with copies, all of its windows repeat.
    bodies = read.filter(f"n_words >= {window}").groupBy("body").agg(F.min(F.struct("id", "text_key")).alias("row"), F.count(F.lit(1)).alias("copies"))
    bodies = kept.put(bodies.select("body", "row.*", "copies", F.monotonically_increasing_id().alias("number")))
    one = read.join(grown(bodies.select("body", "id", "text_key", "number")), ["body", "id", "text_key"]).dropDuplicates(["number"])
    one = one.select("id", "text_key", "number", F.explode(F.arrays_zip("names", "checks", "spots")).alias("a"))
    one = kept.put(one.select("id", "text_key", "number", F.col("a.names").alias("name"), F.col("a.checks").alias("check"), F.col("a.spots").alias("spot")))
    kept.drop(read)
    shared = one.groupBy("name", "check").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = kept.put(shared.select("name", "check", F.monotonically_increasing_id().alias("sym")))
    tokens = one.join(grown(shared), ["name", "check"]).groupBy("id", "text_key", "number").agg(F.array_sort(F.collect_list(F.struct("spot", "sym"))).alias("tokens"))  # a document's own
    tokens = kept.put(tokens.select("id", "text_key", "number", F.col("tokens.spot").alias("spots"), F.col("tokens.sym").alias("syms")))
    kept.drop(one, shared)
    reach = _reach(window)
    seqs = _named_rounds(tokens.select("number", F.col("spots").alias("at"), F.col("spots").alias("last"), F.col("syms").alias("sym")), kept, reach)

    # Starts of the windows that lie in a symbol; one occurrence of each symbol shows its windows to the others.
    long = seqs.select("number", F.explode(F.arrays_zip("at", "last", "sym")).alias("s")).select("number", (F.col("s.at") - SIGHT).alias("from"), (F.col("s.last") - SIGHT + reach - window + 1).alias("to"), "s.sym").filter("from < to")
    long = kept.put(long)
    shows = long.groupBy("sym").agg(F.min(F.struct("number", "from")).alias("shown"))
    proved = kept.put(long.join(grown(shows), "sym").select("number", "from", "to", (F.struct("number", "from") == F.col("shown")).alias("shown")))
    order = F.array_sort(F.collect_list(F.struct("from", "to", "shown")))  # a document's own
    proved = kept.put(proved.groupBy("number").agg(order.alias("p")).select("number", F.col("p.from").alias("from"), F.col("p.to").alias("to"), F.filter("p", lambda x: ~x["shown"]).alias("skip")))
    none = F.array().cast("array<int>")
    asked = tokens.select("id", "text_key", "number", "spots").join(grown(proved), "number", "left")
    asked = kept.put(asked.select("id", "text_key", "number", "spots", F.coalesce("skip.from", none).alias("skip"), F.coalesce("skip.to", none).alias("skip_to")))
    found = rows.join(grown(asked), ["id", "text_key"]).select("text", "number", "spots", "skip", "skip_to").mapInArrow(_windows(window), "number long, start int, print long, check long")
    found = kept.put(found)
    again = kept.put(found.groupBy("print", "check").agg(F.min("number").alias("lo"), F.max("number").alias("hi"), F.min("start").alias("s"), F.max("start").alias("t")).filter("lo < hi or s < t").select("print", "check"))
    starts = kept.put(found.join(grown(again), ["print", "check"]).groupBy("number").agg(F.collect_set("start").alias("starts")))
    plan = bodies.join(grown(starts), "number", "left").join(grown(proved.select("number", "from", "to")), "number", "left")
    plan = plan.select("body", (F.col("copies") > 1).alias("whole"), "starts", "from", "to").filter("whole or starts is not null or from is not null")
    plan = kept.put(plan.select("body", F.when(~F.col("whole"), F.col("starts")).alias("starts"), "whole", F.when(~F.col("whole"), F.col("from")).alias("from"), F.when(~F.col("whole"), F.col("to")).alias("to")))
    kept.drop(found, again, tokens, seqs, long, proved, asked, starts, bodies)
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.struct(*[c for c in docs.columns if c != text_col]).alias("row"))
    given = given.mapInArrow(_with_body, T.StructType([*given.schema.fields, T.StructField("body", T.BinaryType())]))
    joined = given.join(grown(plan), "body", "left").select("doc_id", "text", "row", "starts", "whole", F.coalesce("from", none).alias("from"), F.coalesce("to", none).alias("to"))
    kind = {f.name: f.dataType for f in joined.schema.fields}
    schema = T.StructType([T.StructField("doc_id", kind["doc_id"]), T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("row", kind["row"])])
    return joined.mapInArrow(_remove(window), schema)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op9_substring_dedup": op9_substring_dedup}
ORACLE_SQL = {
    "op9_substring_dedup": """
WITH w AS (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') END AS w FROM documents),
starts AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 34], ' ')) AS words FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM w)),
again AS (SELECT words FROM starts GROUP BY words HAVING count(*) > 1),
gone AS (SELECT doc_id, list(DISTINCT j) AS j FROM (SELECT doc_id, unnest(range(i, i + 35)) AS j FROM starts SEMI JOIN again USING (words)) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(len(j), 0) AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN j IS NULL THEN w ELSE list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(j, x[2])), lambda x: x[1]) END, ' '), '')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id)
"""
}
