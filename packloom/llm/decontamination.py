"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items' words become one automaton over word numbers. Tasks stream the words of their
documents through it and track the longest match that ends at each word; wherever it
reaches the window length, the window's words are hit and the automaton's state tells
which items hold it. Only stretches of words that all occur in items are streamed, as a
word that occurs in none ends every match; all stretches of a chunk go forward together,
a word at a time, over the automaton's arrays.

Items longer than PIECE_WORDS are cut into pieces that overlap by a window, and pieces are dealt into as
many shards as keep each at about SHARD_BYTES of text. Tasks build the shards' automata and store their
arrays; the driver reads their sizes and makes blocks of them. A block has at most BLOCK_BYTES (or
is one shard) and is broadcast to one pass over all documents. A benchmark of several blocks takes a pass for
each; what a pass finds is stored, and the last one merges it, so memory doesn't grow with the benchmark.
"""

from __future__ import annotations

import pickle
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, Stored, chunks_of, fold, grown, ragged, same_bytes, table, text_bytes, word_hashes, words_of

WINDOW = 10
#: Text in a shard (a state of the automaton takes some 30 bytes in arrays, about one state for 6 bytes of
#: text; while it is built a hundred times that), words in a piece of an item and in a piece of a stretch.
SHARD_BYTES, PIECE_WORDS, STRETCH_WORDS = 1 << 20, 5000, 256
#: Bytes of automata that a pass over the documents broadcasts at most.
BLOCK_BYTES = 64 << 20
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
FOLD = {c: c + 32 for c in range(0x41, 0x5B)}


class _Builder:
    """The suffix automaton of some sequences of word numbers, while it grows."""

    def __init__(self):
        self.next, self.link, self.len = [{}], [-1], [0]

    def add(self, words: list[int]) -> None:
        last = 0
        for w in words:
            last = self._extend(last, w)

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            q = self.next[last][word]
            return q if self.len[q] == self.len[last] + 1 else self._clone(last, word, q)
        new = self._state({}, 0, self.len[last] + 1)
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.len[q] == self.len[p] + 1 else self._clone(p, word, q)
        return new

    def _state(self, follow: dict, link: int, length: int) -> int:
        self.next.append(follow)
        self.link.append(link)
        self.len.append(length)
        return len(self.len) - 1

    def _clone(self, p: int, word: int, q: int) -> int:
        new = self._state(dict(self.next[q]), self.link[q], self.len[p] + 1)
        self.link[q] = new
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = new
            p = self.link[p]
        return new


def _lists(of: dict[int, set], n: int, kind) -> tuple[np.ndarray, np.ndarray]:
    """Sets of tuples of numbers by state, as offsets and one flat array."""
    sizes = np.zeros(n + 1, np.int64)
    for k, x in of.items():
        sizes[k + 1] = len(x)
    return np.cumsum(sizes), np.array([y for k in sorted(of) for y in sorted(of[k])], kind)


@dataclass
class SuffixAutomaton:
    """All word sequences of some items in arrays. keys (state * n_words + word) and to: its steps. top: of
    a state for `window` words or more, the one for their last `window`. held: item numbers by top
    state; short: (size, item) of whole short items that end in a state."""

    window: int
    least: int
    n_words: int
    keys: np.ndarray
    to: np.ndarray
    link: np.ndarray
    len: np.ndarray
    top: np.ndarray
    held: tuple[np.ndarray, np.ndarray]
    short: tuple[np.ndarray, np.ndarray]

    @staticmethod
    def of(items: list[tuple[int, list[int]]], n_words: int, window: int) -> SuffixAutomaton:
        grown = _Builder()
        for _, words in items:
            grown.add(words)
        n, link, length = len(grown.len), np.array(grown.link), np.array(grown.len)
        top, short, held = np.zeros(n, np.int64), defaultdict(set), defaultdict(set)
        order = np.argsort(length, kind="stable").tolist()
        for s in order[1:]:
            up = grown.link[s]
            top[s] = 0 if length[s] < window else s if length[up] < window else top[up]
        for name, words in items:
            state = 0
            for w in words:
                state = grown.next[state][w]
                if top[state]:
                    held[int(top[state])].add(name)
            if 0 < len(words) < window:
                short[state].add((len(words), name))
        for s in order[1:]:
            if short.get(grown.link[s]):
                short[s] |= short[grown.link[s]]
        keys = np.array([s * n_words + w for s, step in enumerate(grown.next) for w in step], np.int64)
        to = np.array([t for step in grown.next for t in step.values()], np.int32)
        back = np.argsort(keys)
        least = min([window, *(len(w) for _, w in items if w)])
        return SuffixAutomaton(window, least, n_words, keys[back], to[back], link.astype(np.int32), length.astype(np.int32), top.astype(np.int32), _lists(held, n, np.int32), _lists(short, n, np.int32))

    def stream(self, code: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The state and matched length at each word of the stretches [begin, end) of document words."""
        states, lengths = np.zeros(len(code), np.int32), np.zeros(len(code), np.int32)
        order = np.argsort(begin - end, kind="stable")  # the longest first, so those that go on are the first ones
        begin, size = begin[order], (end - begin)[order]
        state, length = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
        for step in range(int(size.max()) if len(size) else 0):
            live = int(np.searchsorted(-size, -step))
            state, length = state[:live], length[:live]
            word, todo = code[begin[:live] + step], np.arange(live)
            while len(todo):
                key = state[todo] * self.n_words + word[todo]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                found = self.keys[at] == key
                state[todo[found]] = self.to[at[found]]
                length[todo[found]] += 1
                todo = todo[~found]
                stuck = todo[state[todo] == 0]
                length[stuck] = 0
                todo = todo[state[todo] != 0]
                state[todo] = self.link[state[todo]]
                length[todo] = self.len[state[todo]]
            states[begin[:live] + step], lengths[begin[:live] + step] = state, length
        return states, lengths

    def hits(self, code: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, item number) of the hit spans in the stretches, a span for each item."""
        # A long stretch is cut into pieces that overlap by a window less a word.
        pieces = np.maximum(1, -(-(end - begin - self.window + 1) // STRETCH_WORDS))
        which = np.repeat(np.arange(len(begin)), pieces)
        place = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = begin[which] + place * STRETCH_WORDS
        end = np.minimum(end[which], begin + STRETCH_WORDS + self.window - 1)
        out = [(np.zeros(0, np.int64),) * 3]
        # Neighbouring pieces share words, so they go in turns.
        for turn in (0, 1):
            mine = place % 2 == turn
            states, lengths = self.stream(code, begin[mine], end[mine])
            at = np.flatnonzero(lengths >= self.window)
            row, item = self._of(self.held, self.top[states[at]])
            out.append((at[row] + 1 - self.window, at[row] + 1, item))
            at = np.flatnonzero(np.diff(self.short[0])[states] > 0) if len(self.short[1]) else at[:0]
            row, pair = self._of(self.short, states[at])
            if len(row):
                fits = pair[:, 0] <= lengths[at[row]]
                row, pair = row[fits], pair[fits]
                out.append((at[row] + 1 - pair[:, 0], at[row] + 1, pair[:, 1]))
        start, past, item = (np.concatenate(x) for x in zip(*out, strict=True))
        return start, past, item

    @staticmethod
    def _of(lists: tuple[np.ndarray, np.ndarray], states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = lists[0][states + 1] - lists[0][states]
        return np.repeat(np.arange(len(states)), sizes), lists[1][ragged(lists[0][states], sizes)]


@dataclass
class Shard:
    """An automaton, the names of its items, and their words: sorted fingerprints, numbers, bytes and where those start."""

    machine: SuffixAutomaton
    names: list[str]
    known: np.ndarray
    number: np.ndarray
    letters: np.ndarray
    letters_at: np.ndarray


def _shard(items: list[tuple[str, str]], window: int) -> Shard:
    number: dict[str, int] = {}
    names = sorted({name for name, _ in items})
    of = {name: k for k, name in enumerate(names)}
    coded = [(of[name], [number.setdefault(w, len(number)) for w in WORD.findall(text.translate(FOLD))]) for name, text in items]
    raw = [w.encode("utf-8", "surrogatepass") for w in number]
    at = np.cumsum([0, *map(len, raw)])
    letters = np.frombuffer(b"".join(raw), np.uint8)
    known = word_hashes(letters, at[:-1], at[1:])
    order = np.argsort(known)
    return Shard(SuffixAutomaton.of(coded, len(number), window), names, known[order], order, letters, at)


def _pieces(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(name, text) of the items, long ones in overlapping pieces."""
    words = F.regexp_extract_all(F.col(text_col), F.lit("([^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+)"), F.lit(1))
    named = items.filter(F.col(text_col).isNotNull()).select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("name"), words.alias("w"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)), F.lit(PIECE_WORDS))
    return named.filter("size(w) > 0").select("name", "w", F.explode(starts).alias("s")).select("name", F.array_join(F.slice("w", F.col("s") + 1, F.lit(PIECE_WORDS + window - 1)), " ").alias("text"))


def _built(window: int):
    """A shard's automaton from its pieces, about SHARD_BYTES of text, as arrays in one binary value."""

    def run(key, pieces):
        rows = list(zip(pieces["name"].to_pylist(), pieces["text"].to_pylist(), strict=True))
        shard = _shard(rows, window)
        done = pickle.dumps({**vars(shard), "machine": vars(shard.machine)})  # arrays and lists only
        return pa.table({"k": pa.array([key[0].as_py()], pa.int64()), "size": pa.array([len(done)], pa.int64()), "shard": pa.array([done], pa.binary())})

    return run


def _blocks(items: DataFrame, id_col: str, text_col: str, window: int, shard_bytes: int, block_bytes: int, kept: Stored) -> tuple[DataFrame | None, list[tuple[int, int]]]:
    """The shards as a stored table, and the first and last number of those in each block."""
    pieces = _pieces(items, id_col, text_col, window)
    total = pieces.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if not total:
        return None, []
    dealt = pieces.withColumn("k", F.pmod(F.xxhash64("name", "text"), F.lit(-(-total // shard_bytes))))
    built = kept.put(dealt.groupBy("k").applyInArrow(_built(window), "k long, size long, shard binary"))
    blocks, held = [], 0
    for k, size in built.select("k", "size").orderBy("k").collect():  # a row for each MB of the benchmark
        if blocks and held + size <= block_bytes:
            blocks[-1], held = (blocks[-1][0], k), held + size
        else:
            blocks.append((k, k))
            held = size
    return built, blocks


def _shared(built: DataFrame, blocks: list[tuple[int, int]]) -> Iterator[Broadcast]:
    """Each block as a broadcast list of shards."""
    for first, last in blocks:
        rows = built.filter(F.col("k").between(first, last)).select("shard").collect()  # BLOCK_BYTES at most, or one shard
        loaded = [pickle.loads(r.shard) for r in rows]
        yield built.sparkSession.sparkContext.broadcast([Shard(**{**x, "machine": SuffixAutomaton(**x["machine"])}) for x in loaded])


SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def _known(part: np.ndarray, starts: np.ndarray, ends: np.ndarray, shard: Shard) -> tuple[np.ndarray, np.ndarray]:
    """Whether each word is one of the items', and its number."""
    key = word_hashes(part, starts, ends)
    near = np.minimum(np.searchsorted(shard.known, key), len(shard.known) - 1)
    code, hit = shard.number[near], shard.known[near] == key
    at = np.flatnonzero(hit)
    size, begin = (ends - starts)[at], shard.letters_at[code[at]]
    same = size == shard.letters_at[code[at] + 1] - begin
    same[same] = same_bytes(part, starts[at[same]], shard.letters, begin[same], size[same])
    hit[at[~same]] = False
    return hit, code


def _find(shared: Broadcast | None, merge: bool = False):
    """The hits of a block's shards, each looked up once for each chunk of texts; with `merge` the
    spans and items that other passes found (columns 3 and 4) are taken in."""

    def run(batches):
        for b in batches:
            data, offsets = text_bytes(b.column(1))
            n_words, spans, items = [], [], []
            for first, past in chunks_of(offsets):
                part = fold(data[offsets[first] : offsets[past]])
                starts, ends, at = words_of(part, offsets[first : past + 1] - offsets[first], ALNUM)
                n_words += np.diff(at).tolist()
                found = [set(b.column(4)[k].as_py() or () if merge else ()) for k in range(first, past)]
                marks = np.zeros(len(starts) + 1, np.int64)
                for k in range(first, past) if merge else ():
                    for span in b.column(3)[k].as_py() or ():
                        marks[at[k - first] + span["start"]] += 1
                        marks[at[k - first] + span["end"]] -= 1
                for shard in shared.value if shared and len(starts) else ():
                    hit, code = _known(part, starts, ends, shard)
                    edge = np.zeros(len(hit) + 1, bool)
                    edge[at] = True
                    padded, prior = np.append(hit, False), np.append(False, hit)
                    begin = np.flatnonzero(padded & (~prior | edge))
                    end = np.flatnonzero(prior & (~padded | edge))
                    long = end - begin >= shard.machine.least
                    start, stop, item = shard.machine.hits(code, begin[long], end[long])
                    np.add.at(marks, start, 1)
                    np.add.at(marks, stop, -1)
                    row = np.searchsorted(at, start, "right") - 1
                    for r, k in {*zip(row.tolist(), item.tolist(), strict=True)}:
                        found[r].add(shard.names[k])
                covered = np.cumsum(marks)[:-1] > 0
                edge = np.zeros(len(covered) + 1, bool)
                edge[at] = True
                padded, prior = np.append(covered, False), np.append(False, covered)
                begin, end = np.flatnonzero(padded & (~prior | edge)), np.flatnonzero(prior & (~padded | edge))
                row = np.searchsorted(at, begin, "right") - 1
                of = [[] for _ in range(first, past)]
                for r, x, y in zip(row.tolist(), (begin - at[row]).tolist(), (end - at[row]).tolist(), strict=True):
                    of[r].append({"start": x, "end": y})
                spans += of
                items += [sorted(x) for x in found]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(items, pa.list_(pa.string())), b.column(2)], ["doc_id", "text", "n_words", "spans", "items", "row"])

    return run


def find_contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, text, n_words, spans (of word numbers, merged),
    items (sorted ids as strings), and row, a struct of the columns of `docs` but the text.

    Words are runs of digits, letters and non-ASCII characters after lower-casing A-Z. A
    window is `window` consecutive words of an item, or a shorter item as a whole. Null
    texts, of documents or items, have no words; items without words hit nothing; an
    item with a null id counts under the empty id, and rows of one id are one item. With
    no items every document is clean. Repeated rows each get the same result.

    `shard_bytes` of benchmark text make an automaton; `block_bytes` of automata are broadcast to a pass
    over `docs`. Neither changes the result."""
    kept = Stored(docs.sparkSession, "decontamination")
    built, blocks = _blocks(items, item_col, item_text_col, window, shard_bytes, block_bytes, kept)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.struct(*[c for c in docs.columns if c != text_col]).alias("row"))
    kind = {f.name: f.dataType for f in rows.schema.fields}
    schema = T.StructType([T.StructField("doc_id", kind["doc_id"]), T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("spans", SPAN), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("row", kind["row"])])
    if len(blocks) < 2:
        last = next(_shared(built, blocks), None)
        kept.drop(*filter(None, [built]))
        return rows.mapInArrow(_find(last), schema)

    body = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    keyed = rows.select("doc_id", "text", body.alias("row"))
    part_schema = T.StructType([*schema.fields[:-1], T.StructField("row", T.StringType())])
    parts = []
    for block in _shared(built, blocks[:-1]):
        # Repeated rows have equal hits, of which one stays.
        part = keyed.mapInArrow(_find(block), part_schema).filter("size(spans) > 0").groupBy("doc_id", "row").agg(F.first("spans").alias("spans"), F.first("items").alias("items"))
        parts.append(kept.put(part))
        block.destroy()
    last = next(_shared(built, blocks[-1:]))
    prior = reduce(DataFrame.unionByName, parts).groupBy(F.col("doc_id").alias("_id"), F.col("row").alias("_body"))  # a row for each pass
    prior = kept.put(prior.agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")))
    kept.drop(built, *parts)
    joined = rows.withColumn("body", body).join(grown(prior), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("body") == F.col("_body")), "left")
    return joined.select("doc_id", "text", "row", "spans", "items").mapInArrow(_find(last, True), schema)


def _cut(batches):
    for b in batches:
        out = []
        for text, spans in zip(b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
            if not spans:
                out.append(text)
                continue
            at = [m.span() for m in WORD.finditer(text.translate(FOLD))]
            kept, past = [], 0
            for s in spans:
                kept.append(text[past : at[s["start"]][0]])
                past = at[s["end"] - 1][1]
            out.append("".join([*kept, text[past:]]))
        yield b.set_column(1, "text", pa.array(out, pa.string()))


def decontaminate(docs: DataFrame, items: DataFrame, max_coverage: float = 0.5, **options) -> DataFrame:
    """find_contamination() with the hit spans cut out of the texts. Documents of which
    more than `max_coverage` of the words are hit are dropped; clean ones stay untouched."""
    found = find_contamination(docs, items, **options)
    hit = F.aggregate("spans", F.lit(0), lambda n, s: n + s["end"] - s["start"])
    return found.filter(hit <= max_coverage * F.col("n_words")).mapInArrow(_cut, found.schema)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


QUERIES = {"op6_decontamination": op6_decontamination}
ORACLE_SQL = {
    "op6_decontamination": """
WITH d AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM (
        SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents)),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
windows AS (
    SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS words
    FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
starts AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS words FROM d, sizes WHERE i + n - 1 <= len(w)),
hits AS (SELECT doc_id, i, n, item FROM starts JOIN windows USING (n, words)),
words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS list FROM hits GROUP BY doc_id)
SELECT doc_id, coalesce(len(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')), 0) AS n_words,
       coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM documents LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
}
