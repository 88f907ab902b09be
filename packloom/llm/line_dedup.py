"""Line dedup by pairwise alignment.

Lines are hashed. Documents overlap where they share a key: a line of at least `least` bytes,
or a run of neighbouring shorter lines that reaches this size together. A rare key, one of at
most `rare` holders, pairs each of them with all earlier ones. A key of more holders pairs each
of them with the first, so that a common line makes one pair for each document, not all.

Each pair is aligned by patience diff over the lines, and aligned common blocks of at least
`least` bytes are deleted from the later document (the one with the larger id). Keys that the
alignment leaves, as they stand in another order or several times, are aligned as moved blocks.
So a line or run of at least `least` bytes that an earlier document holds never stays.

Only hashes travel with the pairs, and of a document only the lines of shared keys and the short
ones beside them; texts are touched once. Two lines are equal if two independent 64-bit
fingerprints are.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Stored, chunks_of, grown, packed, ragged, run_hashes, table, text_bytes, word_hashes

#: Bytes of a line or block that is worth deleting, at most _SIZE.
LEAST_CHARS = 20

#: A key of so few holders pairs all of them.
RARE = 4

#: The low bits of a line's hash are its size, up to this.
_SIZE = 31


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all lines, and for each text the number of its first line."""
    feeds = np.flatnonzero(data == 0x0A)
    starts = np.sort(np.concatenate([offsets[:-1], feeds + 1]), kind="stable")
    ends = np.sort(np.concatenate([offsets[1:], feeds]), kind="stable")
    per_text = 1 + np.diff(np.searchsorted(feeds, offsets))
    return starts, ends, np.append(0, np.cumsum(per_text))


def _keys(h: np.ndarray, size: np.ndarray, at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines where a key starts, how many lines it spans, and its hash."""
    n, row = len(h), np.repeat(np.arange(len(at) - 1), np.diff(at))
    long = size >= least
    # A run ends with the line that makes it large enough, before the next long line and the text's end.
    total = np.append(0, np.cumsum(size))
    past = np.searchsorted(total, total[:-1] + least)
    stops = np.append(np.flatnonzero(long), n)
    limit = np.minimum(stops[np.searchsorted(stops, np.arange(n))], at[1:][row])
    start = np.flatnonzero(long | ((size > 0) & (past <= limit)))
    span = np.where(long[start], 1, past[start] - start)
    return start, span, np.where(long[start], h[start], run_hashes(h, start, start + span))


def _hash_lines(least: int):
    """Line hashes, whose low bits are the line's size, 0 for a blank line; a second hash; and the keys."""

    def run(batches):
        for b in batches:
            data, offsets = text_bytes(b.column(2))
            for first, past in chunks_of(offsets):
                part = data[offsets[first] : offsets[past]]
                starts, ends, at = line_spans(part, offsets[first : past + 1] - offsets[first])
                size = ends - starts
                h = word_hashes(part, starts, ends) & ~np.uint64(_SIZE) | np.minimum(size, _SIZE).astype(np.uint64)
                h = np.where(size == 0, np.uint64(0), h)
                start, _, key = _keys(h, size, at, least)
                row = np.searchsorted(at, start, "right") - 1
                order = np.lexsort((key, row))
                row, key = row[order], key[order]
                new = np.append(True, (row[1:] != row[:-1]) | (key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
                per = np.searchsorted(row[new], np.arange(past - first + 1))
                n = past - first
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first, n), b.column(1).slice(first, n), packed(h.view(np.int64), at, pa.int64()), packed(word_hashes(part, starts, ends, 1).view(np.int64), at, pa.int64()), packed(key[new].view(np.int64), per, pa.int64())],
                    ["id", "body", "lines", "checks", "keys"],
                )

    return run


def _numbers(column: pa.ListArray, row: int) -> np.ndarray:
    return column[row].values.to_numpy(zero_copy_only=False)


def _shorten(least: int):
    """Of each document the lines of shared keys and the short ones beside them, with their places."""

    def run(batches):
        for b in batches:
            at, lines, checks = [], [], []
            for r in range(len(b)):
                h = _numbers(b.column("lines"), r).view(np.uint64)
                size = (h & np.uint64(_SIZE)).astype(np.int64)
                start, span, key = _keys(h, size, np.array([0, len(h)]), least)
                mine = np.isin(key.view(np.int64), _numbers(b.column("keys"), r))
                stays = np.zeros(len(h), bool)
                stays[ragged(start[mine], span[mine])] = True
                # Lines between long ones that aren't shared stay or go together.
                wall = (size >= least) & ~stays
                group = np.cumsum(wall)
                stays = (np.bincount(group, stays, len(h) + 1) > 0)[group] & ~wall
                place = np.flatnonzero(stays)
                at.append(place)
                lines.append(h[place].view(np.int64))
                checks.append(_numbers(b.column("checks"), r)[place])
            per = np.append(0, np.cumsum([len(x) for x in at]))
            flat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("body"), packed(flat(at), per, pa.int32()), packed(flat(lines), per, pa.int64()), packed(flat(checks), per, pa.int64())], ["id", "body", "at", "lines", "checks"])

    return run


def patience_blocks(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """Common blocks (start in a, start in b, length) of two line sequences, in order.

    Lines that are single in both sequences are matched in their longest common order; each
    match grows over equal neighbours, and the stretches between matches are aligned alike."""
    found: list[tuple[int, int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {x: j for j, x in enumerate(b[b0:b1], b0) if x and in_b[x] == 1}
        same = [(i, where[x]) for i, x in enumerate(a[a0:a1], a0) if in_a[x] == 1 and x in where]
        ends: list[int] = []
        top: list[int] = []
        back: list[int] = []
        for k, (_, j) in enumerate(same):
            p = bisect_left(ends, j)
            back.append(top[p - 1] if p else -1)
            if p == len(ends):
                ends.append(j)
                top.append(k)
            else:
                ends[p], top[p] = j, k
        chain = []
        k = top[-1] if top else -1
        while k >= 0:
            chain.append(same[k])
            k = back[k]
        at_a, at_b = a0, b0
        for i, j in reversed(chain):
            if i < at_a or j < at_b:
                continue
            s, t = i, j
            while s > at_a and t > at_b and a[s - 1] == b[t - 1]:
                s, t = s - 1, t - 1
            e, f = i + 1, j + 1
            while e < a1 and f < b1 and a[e] == b[f]:
                e, f = e + 1, f + 1
            if chain and (s > at_a and t > at_b):
                todo.append((at_a, s, at_b, t))
            found.append((s, t, e - s))
            at_a, at_b = e, f
        if chain and at_a < a1 and at_b < b1:
            todo.append((at_a, a1, at_b, b1))
    return sorted(found)


def _coded(places: list[int], lines: list[int], checks: list[int], code: dict, gap: int) -> tuple[list[int], list[int], list[int]]:
    """Codes (0 for a blank line, `gap` where lines were left out), sizes and places."""
    out, sizes, where, before = [], [], [], -1
    for p, h, c in zip(places, lines, checks, strict=True):
        if p != before + 1:
            out.append(gap)
            sizes.append(0)
            where.append(-1)
        out.append(code.setdefault((h, c), len(code) + 1) if h else 0)
        sizes.append(h & _SIZE)
        where.append(p)
        before = p
    return out, sizes, where


def _key_spans(codes: list[int], sizes: list[int], least: int):
    """(start, past) of the keys of a document."""
    for i, size in enumerate(sizes):
        total, past = 0, i
        while size and past < len(sizes) and codes[past] >= 0 and total < least and (past == i or sizes[past] < least):
            total += sizes[past]
            past += 1
        if total >= least:
            yield i, past


def common_lines(a: list[int], b: list[int], sizes: list[int], least: int) -> set[int]:
    """Numbers of the lines of `a` in blocks of at least `least` bytes that `b` has as well: those
    that patience diff aligns, then moved ones. Negative codes are gaps, which equal nothing."""
    gone: set[int] = set()
    for s, _, n in patience_blocks(a, b):
        if sum(sizes[s : s + n]) >= least:
            gone.update(range(s, s + n))
    of = dict(zip(a, sizes, strict=True))
    held = {tuple(b[j:p]): j for j, p in _key_spans(b, [of.get(x, 0) if x > 0 else 0 for x in b], least)}
    for i, past in _key_spans(a, sizes, least):
        j = held.get(tuple(a[i:past]), -1)
        if j < 0 or gone.issuperset(range(i, past)):
            continue
        to, s, t = j + past - i, i, j
        while s > 0 and t > 0 and s - 1 not in gone and a[s - 1] == b[t - 1]:
            s, t = s - 1, t - 1
        while past < len(a) and to < len(b) and past not in gone and a[past] == b[to]:
            past, to = past + 1, to + 1
        gone.update(range(s, past))
    return gone


def _align(least: int):
    """Of each pair the later document's lines that go."""

    def run(batches):
        for b in batches:
            out = []
            for r in range(len(b)):
                code: dict[tuple[int, int], int] = {}
                later, sizes, where = _coded(*(b.column(c)[r].as_py() for c in ("at", "lines", "checks")), code, -1)
                earlier = _coded(*(b.column("first_" + c)[r].as_py() for c in ("at", "lines", "checks")), code, -2)[0]
                out.append(sorted(where[k] for k in common_lines(later, earlier, sizes, least)))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("body"), pa.array(out, pa.list_(pa.int32()))], ["id", "body", "gone"])

    return run


def _delete(batches):
    for b in batches:
        texts, counts = [], []
        for text, gone in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            lines = (text or "").split("\n")
            counts.append(len(lines))
            if gone:
                drop = set(gone)
                text = "\n".join(x for i, x in enumerate(lines) if i not in drop)
            texts.append(text)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array([len(g) if g else 0 for g in b.column(2).to_pylist()], pa.int64()), b.column(3)], ["doc_id", "text", "n_lines", "n_removed", "row"])


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_CHARS, rare: int = RARE) -> DataFrame:
    """One row per row of `docs`: doc_id, text (without the deleted lines), n_lines (before),
    n_removed, and row, a struct of the columns of `docs` but the text.

    Lines end at \\n and are equal when identical. Of two documents the one with the larger
    id is the later one; of different texts under one id, the one whose hash is larger. Rows
    with a null id are kept whole and pair with nothing. Repeated rows are one document: all
    get the same deletions. A null text stays null and counts as one empty line. Lines and blocks
    under `least` bytes (31 at most) stay, unless they are part of a larger block. `rare` chooses
    the pairs; whatever it is, every key that an earlier document holds goes."""
    if not 0 < least <= _SIZE:
        raise ValueError(f"least must be 1 to {_SIZE}")
    kept = Stored(docs.sparkSession, "line-dedup")
    body = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    read = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), body.alias("body"), F.col(text_col).alias("text"))
    lines = kept.put(read.mapInArrow(_hash_lines(least), "id long, body long, lines array<long>, checks array<long>, keys array<long>"))

    me, first = F.struct("id", "body"), F.col("first")
    held = lines.select("id", "body", F.explode("keys").alias("key"))
    shared = kept.put(held.groupBy("key").agg(F.min(me).alias("first"), F.max(me).alias("last"), F.count(F.lit(1)).alias("holders")).filter("first != last").drop("last"))
    mine = kept.put(held.join(grown(shared), "key"))
    few = mine.filter(F.col("holders") <= rare).groupBy("key").agg(F.array_sort(F.collect_set(me)).alias("all"))  # at most `rare`
    few = few.select("all", F.posexplode("all").alias("n", "later")).select("later.*", F.explode(F.slice("all", F.lit(1), F.col("n"))).alias("first"))
    many = mine.filter(F.col("holders") > rare).filter(me != first).select("id", "body", "first")
    pairs = kept.put(few.unionByName(many).select("id", "body", F.col("first.id").alias("first_id"), F.col("first.body").alias("first_body")).distinct())

    own = mine.groupBy("id", "body").agg(F.collect_set("key").alias("keys"))  # a document's own
    part = lines.select("id", "body", "lines", "checks").join(grown(own), ["id", "body"]).mapInArrow(_shorten(least), "id long, body long, at array<int>, lines array<long>, checks array<long>")
    part = kept.put(part.dropDuplicates(["id", "body"]))
    kept.drop(shared, mine, lines)
    earlier = part.select(F.col("id").alias("first_id"), F.col("body").alias("first_body"), *[F.col(c).alias("first_" + c) for c in ("at", "lines", "checks")])
    both = pairs.join(grown(part), ["id", "body"]).join(grown(earlier), ["first_id", "first_body"])
    aligned = both.mapInArrow(_align(least), "id long, body long, gone array<int>")
    gone = kept.put(aligned.select("id", "body", F.explode("gone").alias("line")).groupBy("id", "body").agg(F.collect_set("line").alias("gone")))  # at most a document's lines
    kept.drop(pairs, part)

    whole = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.struct(*[c for c in docs.columns if c != text_col]).alias("row"), F.col(id_col).cast("long").alias("id"), body.alias("body"))
    joined = whole.join(grown(gone), ["id", "body"], "left").select("doc_id", "text", "gone", "row")
    kind = {f.name: f.dataType for f in joined.schema.fields}
    schema = T.StructType([T.StructField("doc_id", kind["doc_id"]), T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("row", kind["row"])])
    return joined.mapInArrow(_delete, schema)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op4_line_dedup": op4_line_dedup}
ORACLE_SQL: dict[str, str] = {}
