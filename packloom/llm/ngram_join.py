"""N-gram Jaccard self-join by token-combination prefixes.

A document's tokens are its distinct word shingles. Two documents that link share k of
their first p + k - 1 tokens under any common order, p being the prefix length for the
threshold.

1. Documents with the same set are one class. Only classes go on.
2. In the order of hashes, prefixes are extended by a twentieth of the set. Classes that
   share too few of their extended prefix with any other class link with nothing. Most
   leave here, and only 8 bytes for each of a quarter of the shingles are shuffled.
3. Tokens that the same documents hold (those of a passage, say) are one token class, of as
   much weight as it has tokens. Classes are ordered by frequency, rarest first. Rare ones of
   the prefix are index keys. Of frequent ones, combinations of 2, 4 and 8 are: the first k
   classes that two linked documents share, so a document is indexed under each choice of k whose
   classes left out before the last weigh no more than a linked document can lack (which extends the
   prefix with k); where the classes end, fewer than k are a key as well. k grows while a
   document has at most COMBINATIONS choices; those of its largest k lead to other documents, and
   its smaller ones are found by documents that have no larger. A document with too many
   choices of 2 is led by single classes.
4. A key's documents are not all paired. In each round a key's next leads, those with the
   earliest positions, are paired with its documents of other components; pairs that the
   positions or sizes rule out are skipped, the rest verified on whole sets, and components
   joined. Keys whose documents are all joined, or can't link any more, leave. It ends when
   no key has an untested pair, so no link between components is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACED, Stored, chunks_of, fold, grown, mix, numbered, packed, ragged, run_hashes, table, text_bytes, word_hashes, words_of
from .components import components

SHINGLE = 5
#: Tokens of more documents than this are frequent.
RARE = 8
#: Sizes of combinations, and how many of one size a document is indexed under at most.
SIZES, COMBINATIONS = (2, 4, 8), 64


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Each text's sorted distinct shingles, flat, with row offsets."""
    data = fold(data)
    starts, ends, at = words_of(data, offsets, SPACED)
    words = word_hashes(data, starts, ends)
    n_words = np.diff(at)
    n = np.where(n_words >= size, n_words - size + 1, np.minimum(n_words, 1))
    first = ragged(at[:-1], n)
    row = np.repeat(np.arange(len(n)), n)
    keys = run_hashes(words, first, np.minimum(first + size, at[1:][row]))
    order = np.lexsort((keys, row))
    keys, row = keys[order], row[order]
    new = np.append(True, (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])) if len(keys) else np.zeros(0, bool)
    return keys[new], np.searchsorted(row[new], np.arange(len(n) + 1))


def _least_overlap(n):
    """Common tokens that a set of n has with each one it links with, at least: 80 %."""
    return -(-4 * n // 5)


def _band(n):
    return np.minimum(n, n - _least_overlap(n) + n // 20 + 1)


def _sets(size: int, whole: bool):
    """doc_id, body, n, set (a 128-bit digest of the set), tag (64 bits of it) and tokens: all, or the extended prefix."""

    def run(batches):
        for b in batches:
            data, offsets = text_bytes(b.column(2))
            for first, past in chunks_of(offsets):
                keys, at = shingle_sets(data[offsets[first] : offsets[past]], offsets[first : past + 1] - offsets[first], size)
                n = np.diff(at)
                digest = [xxhash.xxh3_128_digest(keys[x:y].tobytes()) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                take = n if whole else _band(n)
                tokens = keys[ragged(at[:-1], take)].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first, past - first), b.column(1).slice(first, past - first), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array([int.from_bytes(x[:8], "little", signed=True) for x in digest], pa.int64()), packed(tokens, np.append(0, np.cumsum(take)), pa.int64())],
                    ["doc_id", "body", "n", "set", "tag", "tokens"],
                )

    return run


_SET_SCHEMA = "doc_id long, body long, n long, set binary, tag long, tokens array<long>"


def _choices(weight: list[int], lost: int, spare: int, size: int, most: int) -> list[tuple[int, tuple]] | None:
    """All choices of `size` of the classes (fewer where the classes end) that leave out a weight of at most
    `spare` before the last one, `lost` of it already: (weight left out, classes). None if over `most`."""
    live, done = [(lost, ())], []
    for i, w in enumerate(weight):
        going = []
        for out, chosen in live:
            (done if len(chosen) + 1 == size else going).append((out, (*chosen, i)))
            if out + w <= spare:
                going.append((out + w, chosen))
        live = going
        if len(live) + len(done) > most:  # each live one ends in a choice of its own
            return None
        if not live:
            break
    return done + [x for x in live if x[1]]


def _entries(rare: int, most: int):
    """Index entries of each set: key, cid, n, pos (weight of the classes that a partner found by the key
    lacks), lead. Tokens come as (df, class); those of this set alone come first in the order and aren't listed."""

    def run(batches):
        for b in batches:
            key, cid, size, pos, lead = [], [], [], [], []
            chosen: dict[int, list] = {k: [] for k in SIZES}  # (place of the set's classes, choice, set, n, pos, lead)
            shared = b.column(2)
            dfs = shared.flatten().field(0).to_numpy(zero_copy_only=False)
            classes = shared.flatten().field(1).to_numpy(zero_copy_only=False).view(np.uint64)
            at = shared.offsets.to_numpy() - shared.offsets[0].as_py()
            names, base = [], 0
            for r, (c, n) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                t, df = classes[at[r] : at[r + 1]], dfs[at[r] : at[r + 1]]
                order = np.lexsort((t, df))
                t, df = t[order], df[order]
                first = np.flatnonzero(np.append(True, (t[1:] != t[:-1]) | (df[1:] != df[:-1])))
                weight = np.diff(np.append(first, len(t)))
                place = n - len(t) + first
                t, df = t[first], df[first]
                spare = n - int(_least_overlap(n))
                often = int(np.searchsorted(df, rare, "right"))
                found: list[tuple[int, list]] = []
                if often < len(t) and place[often] <= spare:
                    heavy = weight[often:].tolist()
                    for k in SIZES:
                        choices = _choices(heavy, int(place[often]), spare, k, most)
                        if choices is None:
                            break
                        found.append((k, choices))
                        if all(len(x) < k for _, x in choices):
                            break
                for k, choices in found:
                    chosen[k] += [(base + often, x, c, n, out, k == found[-1][0]) for out, x in choices]
                names.append(t)
                base += len(t)
                inside = place <= spare
                key.append(t[inside])
                pos.append(place[inside])
                lead.append((df[inside] <= rare) | (not found))
                cid.append(np.full(len(key[-1]), c, np.int64))
                size.append(np.full(len(key[-1]), n, np.int64))
            flat = np.append(np.concatenate([np.zeros(0, np.uint64), *names]), np.uint64(0))
            for k, rows in chosen.items():
                if rows:
                    picked = np.full((len(rows), k), len(flat) - 1)
                    for i, row in enumerate(rows):
                        picked[i, : len(row[1])] = np.add(row[1], row[0])
                    h = np.full(len(rows), k, np.uint64)
                    for column in picked.T:
                        h = mix(h * np.uint64(0x9E3779B97F4A7C15) ^ flat[column])
                    key.append(h)
                    for to, i in ((cid, 2), (size, 3), (pos, 4)):
                        to.append(np.array([row[i] for row in rows], np.int64))
                    lead.append(np.array([row[5] for row in rows], bool))
            flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (key, cid, size, pos, lead)]
            yield pa.RecordBatch.from_arrays([pa.array(flat[0].view(np.int64) if len(flat[0]) else flat[0], pa.int64()), pa.array(flat[1], pa.int64()), pa.array(flat[2], pa.int64()), pa.array(flat[3], pa.int64()), pa.array(flat[4].astype(bool))], ["key", "cid", "n", "pos", "lead"])

    return run


def _verify(batches):
    for b in batches:
        one, two = b.column(2), b.column(3)
        hit = []
        for i in range(len(b)):
            x, y = one[i].values.to_numpy(zero_copy_only=False), two[i].values.to_numpy(zero_copy_only=False)
            both = len(np.intersect1d(x, y, assume_unique=True))
            hit.append(100 * both >= 80 * (len(x) + len(y) - both))
        keep = pa.array(hit, pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(keep)


def _possible(x: str, y: str) -> str:
    """Whether two sets can link if the entries' key holds the first classes that they share."""
    common = f"least({x}.n - {x}.pos, {y}.n - {y}.pos)"
    return f"9 * {common} >= 4 * ({x}.n + {y}.n) and 5 * least({x}.n, {y}.n) >= 4 * greatest({x}.n, {y}.n)"


def _untested(pairs: DataFrame, tested: DataFrame | None, kept: Stored) -> DataFrame:
    """The pairs, once each, but those tested before; these are verified on whole sets."""
    pairs = pairs.distinct()
    return kept.put(pairs if tested is None else pairs.join(grown(tested), ["a", "b"], "left_anti"))


def _component_labels(sets: DataFrame, entries: DataFrame, kept: Stored) -> DataFrame:
    """(node, label) of the classes that link with others, by verified links alone."""

    def verified(pairs: DataFrame) -> DataFrame:
        one = sets.select(F.col("cid").alias("a"), F.col("tokens").alias("x"))
        two = sets.select(F.col("cid").alias("b"), F.col("tokens").alias("y"))
        return pairs.join(grown(one), "a").join(grown(two), "b").select("a", "b", "x", "y").mapInArrow(_verify, "a long, b long")

    ends = [F.least("x.cid", "y.cid").alias("a"), F.greatest("x.cid", "y.cid").alias("b")]
    best = kept.put(entries.filter("lead").groupBy("key").agg(F.min_by(F.struct("cid", "n", "pos"), F.struct("pos", "cid")).alias("s")).select("key", "s.*"))
    pairs = entries.alias("x").join(grown(best).alias("y"), F.expr(f"x.key = y.key and x.cid != y.cid and {_possible('x', 'y')}"))
    tested = _untested(pairs.select(*ends), None, kept)
    label = components(kept.put(verified(tested)), kept)
    leads, changed = 8, True
    while True:
        if changed:
            mine = entries.join(grown(label.withColumnRenamed("node", "cid")), "cid", "left").select("key", "cid", "n", "pos", "lead", F.coalesce("label", "cid").alias("comp"))
            per = kept.put(mine.groupBy("key", "comp").agg(F.min("pos").alias("pos"), F.min("n").alias("least"), F.max("n").alias("most")))
            top = kept.put(per.groupBy("key").agg(F.min(F.struct("pos", "comp")).alias("one"), F.min("least").alias("least"), F.max("most").alias("most"), F.count(F.lit(1)).alias("comps")).filter("comps > 1"))
            other = per.join(grown(top.select("key", F.col("one.comp").alias("first"))), "key").filter("comp != first").groupBy("key").agg(F.min("pos").alias("second"))
            bounds = kept.put(top.join(grown(other), "key"))
            alive = mine.join(grown(bounds), "key").withColumn("facing", F.expr("if(comp = one.comp, second, one.pos)"))
            # Sizes that a partner can have, from both positions; none is left for most.
            alive = alive.filter("greatest(least, (4 * n + 9 * facing) / 5) <= least(most, 5 * n / 4 - 9 * pos / 4)").select("key", "cid", "n", "pos", "lead", "comp")
            alive = numbered(alive, "key", [F.desc("lead"), "pos", "cid"], kept)
            size = (alive.agg(F.max("rank")).first()[0] or 0) + 1
            kept.drop(per, top, bounds)
            if size < 2:
                return label
        pairs = alive.filter(f"lead and rank < {leads}").alias("y").join(grown(alive).alias("x"), F.expr(f"x.key = y.key and x.comp != y.comp and {_possible('x', 'y')}"))
        fresh = _untested(pairs.select(*ends), tested, kept)
        found = kept.put(verified(fresh))
        changed = not found.isEmpty()
        if changed:
            label = components(found, kept, label)
        elif leads >= size:
            return label
        tested = kept.put(tested.unionByName(fresh))
        leads *= 16


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, rare: int = RARE, paired: int = COMBINATIONS) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id, body (a hash of the text, which tells
    rows of one id apart) and group (a number of the component, null without shingles).

    Documents link when their sets of `shingle`-word shingles (A-Z lower-cased; words part at
    ASCII white space; a shorter text is one shingle) have a Jaccard similarity of 0.8 or
    more. component_id is the least id that links reach. Null, empty and blank texts have
    no shingles and are alone. Repeated rows and ids stay; rows of one id with different
    texts are different documents. A row with a null id links like any other and takes the
    least id of its component, null if there is none. A document is indexed under at most `paired`
    combinations of a size of its frequent tokens (of more than `rare` documents), or under single ones
    where that can't be; neither number changes the result."""
    kept = Stored(docs.sparkSession, "ngram-join")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("body"), F.col(text_col).alias("text"))
    short = kept.put(rows.mapInArrow(_sets(shingle, False), _SET_SCHEMA))
    # A class is one set of shingles; it is numbered, and a row of it stands for it.
    classes = short.filter("n > 0").groupBy("set", "tag").agg(F.min("doc_id").alias("rep"), F.min(F.struct("doc_id", "body")).alias("row"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"))
    classes = kept.put(classes.select("set", "tag", "rep", "row.*", "copies", "n", F.monotonically_increasing_id().alias("cid")))

    # Extended prefixes in the order of hashes: too few shared tokens rule a class out. Tags are enough for that.
    tokens = short.filter("n > 0").select("tag", F.explode("tokens").alias("token"))
    shared = kept.put(tokens.groupBy("token").agg(F.min("tag").alias("lo"), F.max("tag").alias("hi")).filter("lo < hi").select("token"))
    hits = tokens.join(grown(shared), "token").groupBy("tag").agg(F.count(F.lit(1)).alias("hits"))
    left = classes.join(grown(hits), "tag").filter("hits >= copies * (4 * n div 5 div 20 + 1)").select("cid", "set", "doc_id", "body")
    left = kept.put(left)
    members = kept.put(short.select("doc_id", "body", "n", "set"))
    kept.drop(short, shared)

    # Only rows that stand for a class are read again; a null id is found as well.
    sets = rows.join(grown(left.select(F.col("doc_id").alias("_id"), F.col("body").alias("_body"))), (F.col("body") == F.col("_body")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select("doc_id", "body", "text")
    sets = sets.mapInArrow(_sets(shingle, True), _SET_SCHEMA).join(grown(left.select("cid", "set")), "set")
    sets = kept.put(sets.dropDuplicates(["set"]).select("cid", "n", "tokens"))
    tokens = sets.select("cid", F.explode("tokens").alias("token"))
    # Tokens of the same classes of documents have one name; two names differ but for a collision of 64 bits.
    df = kept.put(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.bit_xor(F.xxhash64("cid")).alias("name")).filter("df > 1"))
    listed = tokens.join(grown(df), "token").groupBy("cid").agg(F.collect_list(F.struct("df", "name")).alias("shared"))  # at most the set's size
    entries = sets.select("cid", "n").join(grown(listed), "cid").select("cid", "n", "shared").mapInArrow(_entries(rare, paired), "key long, cid long, n long, pos long, lead boolean")
    entries = kept.put(entries)
    kept.drop(df)
    label = _component_labels(sets, entries, kept)

    named = classes.join(grown(label.withColumnRenamed("node", "cid")), "cid", "left").select("set", "rep", F.coalesce("label", "cid").alias("label"))
    least = kept.put(named.groupBy("label").agg(F.min("rep").alias("component_id")))
    named = kept.put(named.join(grown(least), "label").select("set", "component_id", F.col("label").alias("group")))
    kept.drop(sets, entries, left, least, classes)
    out = members.filter("n > 0").join(grown(named), "set").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "body", "group")
    alone = members.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "body", F.lit(None).cast("long").alias("group"))
    return out.unionByName(alone)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs` but near-duplicates: of each component of ngram_components() the text with the
    least id stays (a null id is the largest; of texts under one id, the one whose hash is least),
    and of its repeated rows one. Texts without shingles all stay."""
    kept = Stored(docs.sparkSession, "ngram-dedup")
    found = ngram_components(docs, id_col, text_col, **options).filter("group is not null")
    rows = kept.put(found.groupBy("group", F.col("doc_id").alias("_id"), F.col("body").alias("_body")).agg(F.count(F.lit(1)).alias("n")))
    first = kept.put(rows.groupBy("group").agg(F.min(F.struct(F.col("_id").isNull().alias("x"), F.col("_id").alias("y"), F.col("_body").alias("z"))).alias("first")))
    stays = F.struct(F.col("_id").isNull().alias("x"), F.col("_id").alias("y"), F.col("_body").alias("z")).eqNullSafe(F.col("first"))
    marked = rows.join(grown(first), "group").select("_id", "_body", F.when(~stays, "gone").when(F.col("n") > 1, "once").alias("_mark")).filter("_mark is not null")
    marked = kept.put(marked)
    kept.drop(rows, first)
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("key"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    whole = whole.join(grown(marked), (F.col("text") == F.col("_body")) & F.col("key").eqNullSafe(F.col("_id")), "left")
    out = whole.filter("_mark is null").select("row.*")
    if marked.filter("_mark = 'once'").isEmpty():
        return out
    return out.unionByName(whole.filter("_mark = 'once'").dropDuplicates(["_id", "_body"]).select("row.*"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


QUERIES = {"op3_ngram_join": op3_ngram_join}
ORACLE_SQL: dict[str, str] = {}
