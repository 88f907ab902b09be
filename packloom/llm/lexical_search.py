"""Ranked lexical search of all documents for each item of a query set, by bag deduplication.

A task cuts each text down to the items' vocabulary: how often each of its words occurs, and how many
words the text has in all. Documents with the same such bag and the same length norm are one class: Spark
groups by the bag's bytes, so its hashes choose and the bytes verify. Classes are scored once,
against every item that shares a word, whatever the number of their members; the best classes of each item
are then expanded, their members by ascending id.

Only an item's `k` best classes can hold its `k` best documents: every class has a member of its least
id, so a class that `k` others precede by score and least id has all its members behind `k` documents.
Tasks therefore pass on at most `k` classes an item, and of a class at most its `k` least members
are looked at; a class of a third of all documents costs no more than any other.

The items' words are broadcast, so their size is bounded: items are dealt into blocks of about
BLOCK_BYTES of text by a hash of their ids, and each block is a search of its own over all documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ALNUM, Stored, ascii_lower, chunks_of, fold, grown, ragged, same_bytes, table, text_bytes, word_hashes, words_of

#: Text of the items that are searched for in one pass over the documents.
BLOCK_BYTES = 4 << 20
#: Rows of hashes that are broadcast at most, to find the members of winning classes.
FEW = 1 << 17
#: Scores of classes for items that a task holds at once.
CELLS = 1 << 20
TERM = "([^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+)"
_ENTRY = np.dtype([("term", "<u4"), ("tf", "<u4")])


@dataclass
class Vocabulary:
    """The words of a block of items: sorted fingerprints, their words' numbers, and the words' bytes.
    items[at[t] : at[t + 1]] are the numbers of the items that have word t."""

    known: np.ndarray
    number: np.ndarray
    letters: np.ndarray
    letters_at: np.ndarray
    at: np.ndarray
    items: np.ndarray
    n_items: int

    @staticmethod
    def of(item: np.ndarray, terms: pa.Array, n_items: int) -> Vocabulary:
        """From pairs of an item's number and one of its words."""
        coded = terms.dictionary_encode()
        letters, letters_at = text_bytes(coded.dictionary)
        term = coded.indices.to_numpy(zero_copy_only=False)
        by_term = np.argsort(term, kind="stable")
        known = word_hashes(letters, letters_at[:-1], letters_at[1:])
        order = np.argsort(known, kind="stable")
        at = np.searchsorted(term[by_term], np.arange(len(coded.dictionary) + 1))
        return Vocabulary(known[order], order, letters, letters_at, at, item[by_term], n_items)

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the byte spans that are words of the vocabulary, and the words' numbers. A fingerprint
        finds a word, its bytes prove it."""
        got = word_hashes(data, starts, ends)
        place = np.searchsorted(self.known, got)
        todo = np.flatnonzero(place < len(self.known))
        todo = todo[self.known[place[todo]] == got[todo]]
        places, numbers = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(todo):  # more than once only for words that share a fingerprint
            number = self.number[place[todo]]
            size = self.letters_at[number + 1] - self.letters_at[number]
            equal = size == (ends - starts)[todo]
            equal[equal] = same_bytes(data, starts[todo[equal]], self.letters, self.letters_at[number[equal]], size[equal])
            places.append(todo[equal])
            numbers.append(number[equal])
            todo = todo[~equal]
            place[todo] += 1
            todo = todo[place[todo] < len(self.known)]
            todo = todo[self.known[place[todo]] == got[todo]]
        return np.concatenate(places), np.concatenate(numbers)


def _binary(entries: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column from an array of fixed-size entries and row offsets into it."""
    sizes = (offsets * entries.dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(sizes), pa.py_buffer(np.ascontiguousarray(entries).tobytes())])


def _bags(shared):
    """(doc_id, n, bag): n counts all words of a text, the bag has (word, times) of those of the
    vocabulary, ascending."""

    def run(batches):
        vocabulary = shared.value
        size = max(1, len(vocabulary.number))
        for b in batches:
            data, offsets = text_bytes(b.column(1))
            for first, past in chunks_of(offsets):
                part = fold(data[offsets[first] : offsets[past]])
                starts, ends, at = words_of(part, offsets[first : past + 1] - offsets[first], ALNUM)
                place, term = vocabulary.find(part, starts, ends)
                row = np.searchsorted(at, place, "right") - 1
                pair, times = np.unique(row * size + term, return_counts=True)
                entries = np.empty(len(pair), _ENTRY)
                entries["term"], entries["tf"] = pair % size, times
                bag = _binary(entries, np.searchsorted(pair // size, np.arange(past - first + 1)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, past - first), pa.array(np.diff(at), pa.int64()), bag], ["doc_id", "n", "bag"])

    return run


def _entries(bags: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All entries of a column of bags, and row offsets into them."""
    _, offsets, data = bags.buffers()
    at = np.frombuffer(offsets, np.int32)[bags.offset : bags.offset + len(bags) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw.view(_ENTRY) if len(raw) else np.zeros(0, _ENTRY), (at - at[0]) // _ENTRY.itemsize


def _holders(n_terms: int):
    """(term, df) of the classes in a task, from columns size and bag."""

    def run(batches):
        df = np.zeros(n_terms, np.int64)
        for b in batches:
            entries, at = _entries(b.column(1))
            size = np.repeat(b.column(0).to_numpy(zero_copy_only=False), np.diff(at))
            np.add.at(df, entries["term"].astype(np.int64), size)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(df[some], pa.int64())], ["term", "df"])

    return run


def _best(shared, weights, k: int):
    """(item, class_id, score, least) of the k best classes of each item in a task, best by score and least
    id, from columns class_id, m, least, bag."""

    def run(batches):
        vocabulary, weight = shared.value, weights.value
        posted = np.diff(vocabulary.at)
        top = np.zeros((4, 0), np.int64)  # item, score, least, class
        bar = np.ones(vocabulary.n_items, np.int64)  # a score that is enough to be looked at
        for b in batches:
            ids, m, least = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            entries, at = _entries(b.column(3))
            # Classes go forward in stretches of so many postings and cells.
            cost = np.append(0, np.cumsum(posted[entries["term"]]))[at] + np.arange(len(b) + 1) * vocabulary.n_items
            first = 0
            while first < len(b):
                past = min(len(b), max(first + 1, int(np.searchsorted(cost, cost[first] + CELLS, "right")) - 1))
                own = entries[at[first] : at[past]]
                row = np.repeat(np.arange(past - first), np.diff(at[first : past + 1]))
                term, tf = own["term"].astype(np.int64), own["tf"].astype(np.int64)
                gain = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[first:past][row]))
                score = np.zeros((past - first) * vocabulary.n_items, np.int64)
                cell = np.repeat(row * vocabulary.n_items, posted[term]) + vocabulary.items[ragged(vocabulary.at[term], posted[term])]
                np.add.at(score, cell, np.repeat(gain, posted[term]))
                score = score.reshape(past - first, vocabulary.n_items)
                which, item = np.nonzero(score >= bar)
                new = np.stack([item, score[which, item], least[first + which], ids[first + which]])
                top = np.concatenate([top, new], axis=1)
                top = top[:, np.lexsort((top[3], top[2], -top[1], top[0]))]
                rank = np.arange(top.shape[1]) - np.searchsorted(top[0], top[0])
                full = top[:, rank == k - 1]
                bar[full[0]] = full[1]
                top = top[:, rank < k]
                first = past
        yield pa.RecordBatch.from_arrays([pa.array(top[i], pa.int64()) for i in (0, 3, 1, 2)], ["item", "class_id", "score", "least"])

    return run


def lexical_search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The k best documents of each item: item_id, rank (from 1), doc_id, score.

    Words are runs of letters, digits and non-ASCII characters, with A-Z lower-cased. Over documents that have
    a word, a word of df holders weighs floor(1000 * ln((2N + 2) / (2 df + 1))); a document of n words
    has the norm m = 50 + 50 n N div L, and scores weight * (10^9 tf div (1000 tf + 20 m)) for each word of the
    item. Scores of 0 are left out, equal scores go by ascending id, null ids last.

    A null text has no words. Rows that repeat an id are documents of their own. Rows that repeat an item's id
    are one item with the words of all of them; an item without words, or with a null id, has no
    results. Empty tables give an empty result. Other columns are not looked at, whatever their names.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    named = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")).dropna()
    size = named.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    result = spark.createDataFrame([], named.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).schema)
    for block in range(blocks):
        words = named.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).select("item_id", F.explode(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(TERM), F.lit(1))).alias("term"))
        pairs = words.distinct().toArrow()  # of one block
        if len(pairs):
            result = result.unionByName(_search(rows, pairs, k))
    return result


def _search(rows: DataFrame, pairs: pa.Table, k: int) -> DataFrame:
    spark = rows.sparkSession
    kept, context = Stored(spark, "lexical-search"), spark.sparkContext
    coded = pairs.column("item_id").combine_chunks().dictionary_encode()
    names = pa.table({"item": pa.array(np.arange(len(coded.dictionary)), pa.int64()), "item_id": coded.dictionary})
    vocabulary = Vocabulary.of(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), pairs.column("term").combine_chunks(), len(names))
    n_terms, shared = len(vocabulary.number), context.broadcast(vocabulary)

    bags = kept.put(rows.mapInArrow(_bags(shared), "doc_id long, n long, bag binary"))
    n_docs, n_words = bags.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    m = F.expr(f"50 + (50 * n * {n_docs}L) div {max(1, n_words or 0)}L").alias("m")
    members = bags.filter(F.octet_length("bag") > 0).select("doc_id", m, "bag")
    classes = members.groupBy("m", "bag").agg(F.count(F.lit(1)).alias("size"), F.min("doc_id").alias("least"))
    classes = kept.put(classes.withColumn("class_id", F.monotonically_increasing_id()))

    df = classes.select("size", "bag").mapInArrow(_holders(n_terms), "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    weighed = df.select("term", F.floor(F.lit(1000.0) * F.log((F.lit(2.0) * n_docs + 2) / (F.lit(2.0) * F.col("df") + 1))).cast("long").alias("w")).toArrow()  # a row for each word of the block
    weight = np.zeros(n_terms, np.int64)
    weight[weighed.column("term").to_numpy()] = weighed.column("w").to_numpy()
    weights = context.broadcast(weight)

    least = F.coalesce("least", F.lit((1 << 63) - 1))
    best = classes.select("class_id", "m", least.alias("least"), "bag").mapInArrow(_best(shared, weights, k), "item long, class_id long, score long, least long")
    first = Window.partitionBy("item").orderBy(F.desc("score"), "least", "class_id")
    best = kept.put(best.withColumn("at", F.row_number().over(first)).filter(F.col("at") <= k).drop("at", "least"))
    shared.destroy()
    weights.destroy()

    hashed = F.xxhash64("m", "bag").alias("h")
    winners = kept.put(classes.join(grown(best.select("class_id").distinct()), "class_id").select("class_id", "m", "bag", hashed))
    kept.drop(classes)
    members = members.select("doc_id", "m", "bag", hashed)
    if winners.count() <= FEW:
        members = members.join(F.broadcast(winners.select("h").distinct()), "h", "left_semi")
    low = Window.partitionBy("class_id").orderBy(F.col("doc_id").asc_nulls_last())
    members = members.join(grown(winners), ["h", "m", "bag"]).select("class_id", "doc_id").withColumn("at", F.row_number().over(low)).filter(F.col("at") <= k).drop("at")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    found = members.join(grown(best), "class_id").withColumn("rank", rank).filter(F.col("rank") <= k)
    return found.join(F.broadcast(spark.createDataFrame(names)), "item").select("item_id", "rank", "doc_id", "score")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL = {
    "op11_lexical_search": r"""
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
total AS (SELECT count(DISTINCT doc_id) AS n, count(*) AS l FROM words),
norm AS (SELECT doc_id, 50 + (50 * count(*) * any_value(total.n)) // any_value(total.l) AS m FROM words, total GROUP BY doc_id),
wanted AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * n + 2) / (2 * df + 1))) AS BIGINT) AS w FROM df, total),
scored AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score FROM wanted JOIN weight USING (term) JOIN tf USING (term) JOIN norm USING (doc_id) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER r AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0 WINDOW r AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER r <= 50
"""
}
QUERIES = {"op11_lexical_search": op11_lexical_search}
