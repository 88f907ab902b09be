"""SentencePiece (BPE with byte fallback) encoding and decoding in vectorised merge rounds.

A text is cut into words (a run of spaces and what follows it) and each distinct word of
a chunk is encoded once: all their characters stand in one flat array of symbols, a
round finds the best pair of each word with a segmented minimum over pair ranks, merges
the leftmost occurrences of all words at once and compacts the arrays, until no pair is
left. That equals the library's agenda, since no piece reaches from one word into the
next: only pairs inside a word compete. A word is cut further wherever no piece holds
the two characters side by side, for the same reason.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks_of, packed, ragged, table, text_bytes

#: Bytes of text encoded at once; a worker's arrays take some sixty times as much.
ENCODE_BYTES = 1 << 20
NONE = np.int64(1) << np.int64(40)
META = "▁"


def load_vocabulary(model_path: str) -> dict:
    """Arrays that encoding and decoding need, from a model of the BPE kind whose
    normaliser only adds a dummy prefix. Their size is that of the vocabulary."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    size = model.get_piece_size()
    pieces = [model.id_to_piece(i) for i in range(size)]
    byte_ids = np.zeros(256, np.int64)
    normal = {}
    for i, p in enumerate(pieces):
        if model.is_byte(i):
            byte_ids[int(p[3:5], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            normal[p] = i
    if any(META in p.lstrip(META) for p in normal) or any(p.startswith(META * 2) and p.strip(META) for p in normal):
        raise ValueError("a piece of this model reaches over a word's end")
    symbol = {c: normal.get(c, size + k) for k, c in enumerate(sorted({c for p in normal for c in p}))}
    of = {**normal, **symbol}
    order = {p: r for r, p in enumerate(sorted(normal, key=lambda p: (-model.get_score(normal[p]), normal[p])))}
    pairs, beside = {}, set()
    for p in normal:
        beside.update((ord(a) << 21) | ord(b) for a, b in zip(p, p[1:], strict=False))
        for k in range(1, len(p)):
            if p[:k] in of and p[k:] in of:
                pairs[of[p[:k]] << 32 | of[p[k:]]] = (order[p], normal[p])
    keys = np.array(sorted(pairs), np.int64)
    raw = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) else p.replace(META, " ").encode() for i, p in enumerate(pieces)]
    chars = np.array(sorted(map(ord, symbol)), np.int64)
    return {
        "keys": keys, "ranks": np.array([pairs[k][0] for k in keys.tolist()], np.int64), "made": np.array([pairs[k][1] for k in keys.tolist()], np.int64),
        "chars": chars, "char_ids": np.array([symbol[chr(c)] for c in chars.tolist()], np.int64), "beside": np.array(sorted(beside), np.int64),
        "bytes": byte_ids, "size": size, "eos": model.eos_id(), "raw": np.frombuffer(b"".join(raw), np.uint8), "raw_at": np.cumsum([0, *map(len, raw)]),
    }


def _lookup(v: dict, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank (NONE if there is no such pair) and product of pairs of symbols."""
    key = np.where((left < 0) | (right < 0), -1, left << 32 | np.maximum(right, 0))
    at = np.minimum(np.searchsorted(v["keys"], key), len(v["keys"]) - 1)
    found = v["keys"][at] == key
    return np.where(found, v["ranks"][at], NONE), v["made"][at]


def _merge(v: dict, sym: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols after all merges, the part of each, and how many characters each spans."""
    span = np.ones(len(sym), np.int64)
    idle = []
    order = np.arange(len(sym))  # where each symbol starts, to put finished parts back in order
    while len(sym) > 1:
        rank = np.full(len(sym), NONE)
        same = part[1:] == part[:-1]
        rank[:-1][same] = _lookup(v, sym[:-1][same], sym[1:][same])[0]
        made_of = rank < NONE
        heads = np.flatnonzero(np.append(True, ~same))
        best = np.minimum.reduceat(rank, heads)
        live = best < NONE
        sizes = np.diff(np.append(heads, len(sym)))
        if not live.all():
            stays = np.repeat(live, sizes)
            idle.append((sym[~stays], part[~stays], span[~stays], order[~stays]))
            sym, part, span, order, rank, made_of = (x[stays] for x in (sym, part, span, order, rank, made_of))
            best, sizes = best[live], sizes[live]
            if not len(sym):
                break
        hit = np.flatnonzero(made_of & (rank == np.repeat(best, sizes)))
        # Of occurrences that overlap, as in "aaa", every second one merges.
        new_run = np.append(True, np.diff(hit) != 1)
        run_start = np.flatnonzero(new_run)
        hit = hit[(np.arange(len(hit)) - np.repeat(run_start, np.diff(np.append(run_start, len(hit))))) % 2 == 0]
        first = np.append(True, part[hit[1:]] != part[hit[:-1]])
        product = _lookup(v, sym[hit], sym[hit + 1])[1]
        # All occurrences in a part merge at once unless a pair that this makes would come first.
        merged_before = np.append(False, hit[1:] - 2 == hit[:-1])
        left = np.where(merged_before, np.append(0, product[:-1]), sym[np.maximum(hit - 1, 0)])
        has_left = (hit > 0) & (part[np.maximum(hit - 1, 0)] == part[hit])
        right_at = np.minimum(hit + 2, len(sym) - 1)
        has_right = (hit + 2 < len(sym)) & (part[right_at] == part[hit])
        sooner = (has_left & (_lookup(v, left, product)[0] <= rank[hit])) | (has_right & (_lookup(v, product, sym[right_at])[0] <= rank[hit]))
        unsafe = np.logical_or.reduceat(sooner, np.flatnonzero(first))
        take = first | ~np.repeat(unsafe, np.diff(np.append(np.flatnonzero(first), len(hit))))
        hit, product = hit[take], product[take]
        sym = sym.copy()
        sym[hit] = product
        span[hit] += span[hit + 1]
        keep = np.ones(len(sym), bool)
        keep[hit + 1] = False
        sym, part, span, order = sym[keep], part[keep], span[keep], order[keep]
    idle.append((sym, part, span, order))
    sym, part, span, order = (np.concatenate(x) for x in zip(*idle, strict=True))
    back = np.argsort(order, kind="stable")
    return sym[back], part[back], span[back]


def encode_words(v: dict, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words data[start:end] (UTF-8, with spaces as they are), and how many each has."""
    lengths = ends - starts
    text = data[ragged(starts, lengths)].tobytes().decode().replace(" ", META)
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    lead = (data[ragged(starts, lengths)] & 0xC0) != 0x80
    word_chars = np.add.reduceat(lead, np.cumsum(np.append(0, lengths[:-1]))).astype(np.int64) if len(lengths) else lengths
    word = np.repeat(np.arange(len(starts)), word_chars)
    at = np.minimum(np.searchsorted(v["chars"], code), len(v["chars"]) - 1)
    sym = np.where(v["chars"][at] == code, v["char_ids"][at], -1)
    key = code[:-1] << 21 | code[1:]
    near = np.minimum(np.searchsorted(v["beside"], key), len(v["beside"]) - 1)
    cut = np.append(True, (word[1:] != word[:-1]) | (v["beside"][near] != key)) if len(code) else np.zeros(0, bool)
    sym, part, span = _merge(v, sym, np.cumsum(cut))
    first = np.cumsum(span) - span
    known = (sym >= 0) & (sym < v["size"])
    # A character that is no piece becomes its bytes.
    odd = code[first[~known]] if len(sym) else np.zeros(0, np.int64)
    raw = [chr(c).encode("utf-8", "surrogatepass") for c in odd.tolist()]
    count = np.ones(len(sym), np.int64)
    count[~known] = [len(x) for x in raw]
    ids = np.repeat(sym, count)
    ids[np.repeat(~known, count)] = v["bytes"][np.frombuffer(b"".join(raw), np.uint8)]
    return ids, np.bincount(word[first], weights=count, minlength=len(starts)).astype(np.int64)


def encode(v: dict, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids of all texts, each ended by the end id, and row offsets."""
    rows = len(offsets) - 1
    full = np.diff(offsets) > 0
    prefixed = np.insert(data, offsets[:-1][full], 0x20)
    at = offsets + np.append(0, np.cumsum(full))
    space = prefixed == 0x20
    edge = np.zeros(len(prefixed) + 1, bool)
    edge[at] = True
    starts = np.flatnonzero(space & (~np.append(False, space[:-1]) | edge[:-1]))
    ends = np.append(starts[1:], len(prefixed)) if len(starts) else starts
    row_of = np.searchsorted(at, starts, "right") - 1
    if len(starts):
        # Words lie side by side, so they are an Arrow array as they are; equal ones are found by their bytes.
        each = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(prefixed)).astype(np.int32)), pa.py_buffer(prefixed)])
        which = each.dictionary_encode().indices.to_numpy()
        where = np.zeros(which.max() + 1, np.int64)
        where[which[::-1]] = np.arange(len(which))[::-1]
        ids, counts = encode_words(v, prefixed, starts[where], ends[where])
        begin = np.cumsum(counts) - counts
        out = ids[ragged(begin[which], counts[which])]
        sizes = np.bincount(row_of, weights=counts[which], minlength=rows).astype(np.int64)
    else:
        out, sizes = np.zeros(0, np.int64), np.zeros(rows, np.int64)
    past = np.cumsum(sizes)
    return np.insert(out, past, v["eos"]), np.append(0, past + np.arange(1, rows + 1))


def decode(v: dict, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
    """Texts of rows of ids: pieces in a row, bytes put together, without the dummy prefix."""
    sizes = np.diff(v["raw_at"])[ids]
    raw = v["raw"][ragged(v["raw_at"][:-1][ids], sizes)].tobytes()
    at = np.append(0, np.cumsum(sizes))[offsets].tolist()
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        out.append(raw[a + (b > a and raw[a] == 0x20) : b].decode("utf-8", "replace"))
    return out


def _plain(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with U+2581 as a space, which is what the library takes it for."""
    hit = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)) if len(data) > 2 else np.zeros(0, np.int64)
    if not len(hit):
        return data, offsets
    data = data.copy()
    data[hit] = 0x20
    gone = np.zeros(len(data) + 1, np.int64)
    gone[hit + 1], gone[hit + 2] = 1, 1
    return data[gone[:-1] == 0], offsets - np.append(0, np.cumsum(gone))[offsets]


def _round_trip(shared):
    def run(batches):
        v = shared.value
        for b in batches:
            data, offsets = text_bytes(b.column(1))
            for first, past in chunks_of(offsets, ENCODE_BYTES):
                ids, at = encode(v, *_plain(data[offsets[first] : offsets[past]], offsets[first : past + 1] - offsets[first]))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, past - first), packed(ids.astype(np.int32), at, pa.int32()), pa.array(decode(v, ids, at), pa.string()), b.column(2).slice(first, past - first)], ["doc_id", "ids", "decoded", "row"])

    return run


def sentencepiece_codec(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, ids (with the end id), decoded, and row, a struct
    of all columns of `docs` but the text.

    A null or empty text has the end id alone and decodes to the empty text. Repeated
    rows and null ids are rows like any other. Only the vocabulary is broadcast; its
    size is fixed by the model."""
    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(model_path))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.struct(*[c for c in docs.columns if c != text_col]).alias("row"))
    kind = {f.name: f.dataType for f in rows.schema.fields}
    schema = T.StructType([T.StructField("doc_id", kind["doc_id"]), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType()), T.StructField("row", kind["row"])])
    return rows.mapInArrow(_round_trip(shared), schema)


def model_file(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = sentencepiece_codec(table(spark, sf_dir, "documents").select("doc_id", "text"), model_file())
    return done.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


QUERIES = {"op5_sentencepiece": op5_sentencepiece}
ORACLE_SQL: dict[str, str] = {}
