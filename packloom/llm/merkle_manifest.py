"""Merkle manifest of a dataset by lag and lead windows.

Each row is a leaf; the leaves of a group, in order, form a tree whose nodes have up to ARITY children, and
the groups' roots form another. A node stands in the row of its first leaf. At level k the nodes of a
group are therefore ARITY^k rows apart, so columns at fixed offsets before and after a row, masked by the node's
slot in its run and by the length of the run, are its siblings; the first child's row hashes the
parent. Proofs go the other way: a node's is its siblings and then the proof of its parent, which
stands a fixed number of rows before it, by its slot.

A group can hold most rows, so no window spans it: windows span blocks of ARITY^LEVELS leaves, which no run
crosses. Blocks' roots are the nodes of the next round, of which there are few (five for 10^11 rows). On
the way back, a block gets the proof of its root by a join on group and block, and its windows use the
join's partitioning. Texts are hashed where they are read; only digests are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Stored, grown, numbered, table

ARITY, LEVELS = 3, 5
BLOCK = ARITY**LEVELS


def _block():
    return Window.partitionBy("group", "block").orderBy("pos")


def digest(*columns: Column) -> Column:
    """SHA-256 of the columns' digests or field codes, one after another, as lowercase hex."""
    return F.sha2(F.concat(*columns), 256)


def field(value: Column) -> Column:
    """A value with its UTF-8 length before it, so that neighbouring fields can't run together; `-` if null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _level(rows: DataFrame, k: int) -> DataFrame:
    """Adds the siblings before and after each node of level k, and the nodes of level k + 1. pos counts a
    group's n leaves."""
    step = ARITY**k
    node = F.expr(f"pos div {step}L")
    nodes = F.expr(f"(n + {step - 1}L) div {step}L")
    slot = F.pmod(node, F.lit(ARITY))
    run = F.least(F.lit(ARITY), nodes - (node - slot))
    near = {i: (F.lag(f"d{k}", -i * step) if i < 0 else F.lead(f"d{k}", i * step)).over(_block()) for i in range(1 - ARITY, ARITY) if i}
    rows = rows.select("*", *[c.alias(f"near{i}") for i, c in near.items()])
    sibling = lambda i: F.when((slot + i >= 0) & (slot + i < run), F.col(f"near{i}")).otherwise("")
    before, after = (F.concat(*[sibling(i) for i in part]) for part in (range(1 - ARITY, 0), range(1, ARITY)))
    parent = F.when(nodes > 1, digest(F.col(f"d{k}"), after)).otherwise(F.col(f"d{k}"))
    first_child = F.pmod("pos", F.lit(step * ARITY)) == 0
    return rows.select("*", before.alias(f"before{k}"), after.alias(f"after{k}"), F.when(first_child, parent).alias(f"d{k + 1}")).drop(*[f"near{i}" for i in near])


def _blocks(nodes: DataFrame) -> DataFrame:
    """All levels of the blocks of `nodes` (group, pos, n, digest, ...)."""
    rows = nodes.withColumn("d0", F.col("digest"))
    for k in range(LEVELS):
        rows = _level(rows, k)
    return rows


def _rounds(nodes: DataFrame, kept: Stored) -> list[DataFrame]:
    """`nodes`, the roots of their blocks, the roots of those blocks, ... until each group has one."""
    out = [nodes]
    while (out[-1].agg(F.max("n")).first()[0] or 0) > 1:
        rows = _blocks(out[-1].withColumn("block", F.expr(f"pos div {BLOCK}L"))).filter(F.pmod("pos", F.lit(BLOCK)) == 0)
        out.append(kept.put(rows.select("group", F.col("block").alias("pos"), F.expr(f"(n + {BLOCK - 1}L) div {BLOCK}L").alias("n"), F.col(f"d{LEVELS}").alias("digest"))))
    return out


def _proofs(rounds: list[DataFrame], tops: DataFrame, kept: Stored) -> DataFrame:
    """The first of `rounds` with the columns of `tops` (group, path, ...), where path is the proof of each
    group's root, and in the result of each node: the digests before and after it, by level."""
    extra = [c for c in tops.columns if c not in ("group", "path")]
    above = tops.withColumn("pos", F.lit(0).cast("long"))
    for at in range(len(rounds) - 2, -1, -1):
        rows = rounds[at].withColumn("block", F.expr(f"pos div {BLOCK}L")).join(grown(above.withColumnsRenamed({"pos": "block", "path": "upper"})), ["group", "block"])
        rows = _blocks(rows).withColumn(f"path{LEVELS}", F.expr("cast(array() as array<struct<before: string, after: string>>)"))
        for k in range(LEVELS - 1, -1, -1):
            step = ARITY**k
            slot = F.pmod(F.expr(f"pos div {step}L"), F.lit(ARITY))
            parents = [F.col(f"path{k + 1}"), *[F.lag(f"path{k + 1}", i * step).over(_block()) for i in range(1, ARITY)]]
            rows = rows.select("*", *[p.alias(f"parent{i}") for i, p in enumerate(parents)])
            parent = F.coalesce(*[F.when(slot == i, F.col(f"parent{i}")) for i in range(ARITY)])
            own = F.array(F.struct(F.col(f"before{k}").alias("before"), F.col(f"after{k}").alias("after")))
            many = F.expr(f"(n + {step - 1}L) div {step}L") > 1
            rows = rows.select("*", F.when(many, F.concat(own, parent)).otherwise(parent).alias(f"path{k}")).drop(*[f"parent{i}" for i in range(ARITY)])
        rows = rows.select(*[c for c in rounds[at].columns], *extra, F.concat("path0", "upper").alias("path"))
        above = rows if at == 0 else kept.put(rows.select("group", "pos", *extra, "path"))
    return above if len(rounds) > 1 else rounds[0].join(grown(tops), "group")


def merkle_manifest(docs: DataFrame, leaf: Column, group: Column, order: list[Column], keep: list[Column] = ()) -> DataFrame:
    """One row per row of `docs`: the columns of `keep`, leaf, subroot (of its group), root, and path: for each level,
    from the leaf via the subroot to the root, the siblings' digests before and after the node.

    `leaf` is a digest of a row. Leaves ascend by `order` in their group (nulls first, rows that tie by their
    digests), groups by `group` as a text (null first, then by its bytes). While a tree has several
    nodes, each ARITY consecutive ones become the digest of their digests, the last ones as many as are
    left, even one. A lone leaf is its group's subroot, a lone subroot the root. An empty table
    gives an empty result; repeated rows are leaves of their own; nothing else of `docs` is read, whatever
    its columns' names.
    """
    kept = Stored(docs.sparkSession, "merkle-manifest")
    keyed = F.coalesce(F.concat(F.lit("1"), group.cast("string")), F.lit("0"))
    rows = kept.put(docs.select(keyed.alias("group"), leaf.alias("digest"), F.struct(*order).alias("order"), F.struct(F.lit(0).alias("_"), *keep).alias("keep")))
    leaves = numbered(rows, "group", ["order", "digest"], kept, "pos", total="n").drop("order")
    kept.drop(rows)
    rounds = _rounds(leaves, kept)
    subroots = rounds[-1].select(F.lit(0).alias("group"), F.col("group").alias("name"), "digest")
    sources = _rounds(numbered(subroots, "group", ["name"], kept, "pos", total="n"), kept)
    root = sources[-1].select("digest").first()
    top = sources[-1].select("group", F.expr("cast(array() as array<struct<before: string, after: string>>)").alias("path"))
    tops = kept.put(_proofs(sources, top, kept).select(F.col("name").alias("group"), F.col("digest").alias("subroot"), "path"))
    done = _proofs(rounds, tops, kept)
    return done.select(*[F.col(f"keep.{c}") for c in done.schema["keep"].dataType.names[1:]], F.col("digest").alias("leaf"), "subroot", F.lit(root[0] if root else None).cast("string").alias("root"), "path")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(path, leaf, lambda node, x: digest(x["before"], node, x["after"]))


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings of a proof, left to right, level by level."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["before"], x["after"])), ""), 256)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    leaf = lambda text: digest(*[field(c) for c in (F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)])
    hit = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    found = F.when(hit, leaf(F.replace(F.col("text"), F.lit("\n"), F.lit("")))).otherwise(leaf(F.col("text")))
    rows = merkle_manifest(docs, leaf(F.col("text")), F.col("source"), [F.col("doc_id")], [F.col("doc_id"), found.alias("found")])
    rows = rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), folded(F.col("found"), F.col("path")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


ORACLE_SQL = {
    "op12_merkle_manifest": """
WITH RECURSIVE told AS (SELECT doc_id, source, text, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
        lambda crc, x: list_reduce(list_prepend(xor(crc, x), range(8)), lambda y, i: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384) ELSE y // 2 END)) % 2 = 1 AS hit,
        head FROM (SELECT *, concat(CASE WHEN doc_id IS NULL THEN '-' ELSE concat(strlen(CAST(doc_id AS VARCHAR)), ':', doc_id) END, CASE WHEN source IS NULL THEN '-' ELSE concat(strlen(source), ':', source) END,
        CASE WHEN lang IS NULL THEN '-' ELSE concat(strlen(lang), ':', lang) END, CASE WHEN n_chars IS NULL THEN '-' ELSE concat(strlen(CAST(n_chars AS VARCHAR)), ':', n_chars) END) AS head FROM documents)),
leaves AS (SELECT doc_id, source, sha256(concat(head, CASE WHEN text IS NULL THEN '-' ELSE concat(strlen(text), ':', text) END)) AS leaf,
        sha256(concat(head, CASE WHEN text IS NULL THEN '-' ELSE concat(strlen(replace(text, chr(10), '')), ':', replace(text, chr(10), '')) END)) AS cut, hit FROM told),
own AS (SELECT 0 AS level, source, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n, leaf AS node FROM leaves),
up AS (SELECT * FROM own UNION ALL
        SELECT level + 1, source, pos // 3, (any_value(n) + 2) // 3, sha256(string_agg(node, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY level, source, pos // 3),
subs AS (SELECT source, node AS subroot, level AS depth, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (SELECT 0 AS level, pos, n, subroot AS node FROM subs UNION ALL
        SELECT level + 1, pos // 3, (any_value(n) + 2) // 3, sha256(string_agg(node, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY level, pos // 3),
place AS (SELECT doc_id, l.source, leaf, CASE WHEN hit THEN cut ELSE leaf END AS found, row_number() OVER (PARTITION BY l.source ORDER BY doc_id NULLS FIRST) - 1 AS pos, subroot, depth, s.pos AS spos
        FROM leaves l JOIN subs s ON l.source IS NOT DISTINCT FROM s.source),
near AS (SELECT doc_id, level, string_agg(node, '' ORDER BY u.pos) FILTER (WHERE u.pos < here) AS b, string_agg(node, '' ORDER BY u.pos) FILTER (WHERE u.pos > here) AS a FROM (
            SELECT doc_id, p.source, CAST(r AS INTEGER) AS level, p.pos // CAST(pow(3, r) AS BIGINT) AS here FROM place p, range(0, depth) t(r)) x
            JOIN up u USING (level) WHERE u.source IS NOT DISTINCT FROM x.source AND u.pos // 3 = here // 3 GROUP BY doc_id, level
        UNION ALL
        SELECT doc_id, depth + level, string_agg(node, '' ORDER BY t.pos) FILTER (WHERE t.pos < here), string_agg(node, '' ORDER BY t.pos) FILTER (WHERE t.pos > here) FROM (
            SELECT doc_id, depth, CAST(r AS INTEGER) AS level, spos // CAST(pow(3, r) AS BIGINT) AS here FROM place, range(0, (SELECT max(level) FROM top)) t(r)) x
            JOIN top t USING (level) WHERE t.pos // 3 = here // 3 GROUP BY doc_id, depth, level),
folds AS (SELECT doc_id, 0 AS level, found AS node, '' AS proof FROM place UNION ALL
        SELECT f.doc_id, f.level + 1, sha256(concat(b, node, a)), concat(proof, b, a) FROM folds f JOIN near x ON f.doc_id = x.doc_id AND f.level = x.level),
ends AS (SELECT doc_id, arg_max(node, level) AS folded_root, arg_max(proof, level) AS proof FROM folds GROUP BY doc_id),
root AS (SELECT node AS root FROM top WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded_root, folded_root = root AS verified FROM place JOIN ends USING (doc_id), root
"""
}
QUERIES = {"op12_merkle_manifest": op12_merkle_manifest}
