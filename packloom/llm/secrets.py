"""Secret scans, and what the whole corpus says about each candidate.

A scan cuts every text at the matches of each pattern: pieces and matches alternate, so
their lengths give the positions. Candidates are then counted over all documents by
distinct repositories and owners. One that several owners hold is a widely copied example;
one that a single owner holds looks live. Long mixed tokens that no pattern names become
spans of kind `owned` when they look live. DataFrame functions only; candidates travel as
hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stored, grown, table

# The base patterns and the least lengths of what they must match.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # whole runs, as a shorter run never holds a longer one
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
KINDS = ("assign", "access", "hex", "owned")
#: Tokens without a name: this long, with a digit and a letter.
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
#: Owners that may hold a candidate which still looks live.
MAX_OWNERS = 1

_FOUND = "array<struct<start:int,kind:int,end:int,value:string>>"


def _matches(text: Column, pattern: str, kind: int, group: int = 0) -> Column:
    """Matches, leftmost and non-overlapping, as (start, kind, end, value) in code points."""
    regex = F.lit(pattern)
    hits = F.arrays_zip(F.regexp_extract_all(text, regex, F.lit(0)).alias("hit"), F.regexp_extract_all(text, regex, F.lit(group)).alias("value"), F.slice(F.split(text, pattern, -1), 1, 1 << 30).alias("piece"))
    hits = F.filter(hits, lambda h: h["hit"].isNotNull())
    walked = F.aggregate(
        hits,
        F.struct(F.lit(0).alias("at"), F.array().cast(_FOUND).alias("found")),
        lambda a, h: F.struct(
            (a["at"] + F.length(h["piece"]) + F.length(h["hit"])).alias("at"),
            F.concat(a["found"], F.array(F.struct((a["at"] + F.length(h["piece"])).alias("start"), F.lit(kind).alias("kind"), (a["at"] + F.length(h["piece"]) + F.length(h["hit"])).alias("end"), h["value"].alias("value")))).cast(_FOUND).alias("found"),
        ),
        lambda a: a["found"],
    )
    return F.when(text.rlike(pattern), walked).otherwise(F.array().cast(_FOUND))


def _scan(text: Column) -> tuple[Column, Column]:
    """Base spans in order, and long mixed tokens apart from them."""
    assign = F.filter(_matches(text, ASSIGN, 0, 2), lambda m: F.length(m["value"]) >= LEAST_ASSIGN)
    access = F.filter(_matches(text, ACCESS, 1), lambda m: F.length(m["value"]) >= LEAST_ACCESS)
    base = F.array_sort(F.concat(assign, access, _matches(text, HEX, 2)))
    mixed = F.filter(_matches(text, TOKEN, 3), lambda m: m["value"].rlike("[0-9]") & m["value"].rlike("[A-Za-z]"))
    return base, mixed


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, repo: Column, owner: Column, id_col: str = "doc_id", text_col: str = "text", max_owners: int = MAX_OWNERS) -> DataFrame:
    """One row per row of `docs`: doc_id, base (spans of the patterns), spans (those and the
    owned ones), each an array of (start, kind, end, n_repos, n_owners, live) by start and
    kind.

    A null text counts as empty and has no spans. A null repository or owner counts as the
    empty name. Repeated rows and copies each get their row. Null ids stay null."""
    kept = Stored(docs.sparkSession, "secrets")
    text = F.coalesce(F.col(text_col), F.lit(""))
    base, mixed = _scan(text)
    read = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(repo.cast("string"), F.lit("")).alias("repo"), F.coalesce(owner.cast("string"), F.lit("")).alias("owner"), text.alias("text"))
    read = read.withColumns({"base": base, "mixed": mixed})
    apart = F.filter("mixed", lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    found = F.transform(F.concat("base", apart), lambda m: F.struct(m["start"], m["kind"], m["end"], F.sha2(m["value"].cast("binary"), 256).alias("secret")))
    scanned = read.select("doc_id", "repo", "owner", found.alias("found"), F.col("text").alias("text"))
    scanned = kept.put(scanned.select("doc_id", "repo", "owner", "found", F.when(F.size("found") > 0, F.sha2(F.col("text").cast("binary"), 256)).alias("body")))
    some = scanned.filter(F.size("found") > 0)
    # Owners and repositories of each candidate. Rows shrink to distinct triples before the shuffle.
    held = some.select("repo", "owner", F.explode(F.array_distinct(F.transform("found", lambda m: m["secret"]))).alias("secret")).distinct()
    held = kept.put(held.groupBy("secret").agg(F.count_distinct("repo").alias("n_repos"), F.count_distinct("owner").alias("n_owners")))
    # Spans depend on the text alone, so each distinct text is looked up once.
    texts = some.groupBy("body").agg(F.first("found").alias("found")).select("body", F.explode("found").alias("m")).select("body", "m.*")
    looked = kept.put(texts.join(grown(held), "secret").select("body", F.struct("start", "kind", "end", "n_repos", "n_owners", (F.col("n_owners") <= max_owners).alias("live")).alias("m")))
    known = kept.put(looked.groupBy("body").agg(F.array_sort(F.collect_list("m")).alias("found")))
    out = some.select("doc_id", "body").join(grown(known), "body").select("doc_id", "found")
    none = scanned.filter(F.size("found") == 0).select("doc_id", F.array().cast(known.schema["found"].dataType).alias("found"))
    return out.unionByName(none).select(
        "doc_id", F.filter("found", lambda m: m["kind"] < 3).alias("base"), F.filter("found", lambda m: (m["kind"] < 3) | m["live"]).alias("spans")
    )


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source is a repository; its owner is the part of its name before a slash."""
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), F.col("source"), F.substring_index("source", "/", 1))
    n = lambda k: F.size(F.filter("base", lambda m: m["kind"] == k)).cast("long")
    return found.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(_written(F.col("base")).cast("binary"), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda m: m["live"])).cast("long").alias("n_live"), F.size(F.filter("spans", lambda m: ~m["live"])).cast("long").alias("n_examples"),
    )


def _sql_matches(kind: int, pattern: str, group: int, keep: str) -> str:
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, source, {kind} AS kind, v AS value, s AS start, s + length(h) AS stop FROM (
    SELECT doc_id, source, unnest(hits) AS h, unnest(vals) AS v,
           unnest(list_transform(range(1, len(hits) + 1), lambda i: coalesce(list_sum(list_transform(pieces[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0)))::BIGINT AS s
    FROM (SELECT doc_id, source, regexp_extract_all(text, '{p}') AS hits, regexp_extract_all(text, '{p}', {group}) AS vals, string_split_regex(text, '{p}') AS pieces FROM documents WHERE regexp_matches(text, '{p}'))) WHERE {keep}"""


ORACLE_SQL = {
    "op2_secret_scan": f"""
WITH base AS ({_sql_matches(0, ASSIGN, 2, "length(v) >= 6")} UNION ALL {_sql_matches(1, ACCESS, 0, "length(v) >= 20")} UNION ALL {_sql_matches(2, "[0-9a-f]+", 0, "length(v) >= 24")}),
mixed AS ({_sql_matches(3, TOKEN, 0, "regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')")}),
found AS (SELECT * FROM base UNION ALL
    SELECT * FROM mixed m WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = m.doc_id AND b.start < m.stop AND m.start < b.stop)),
held AS (SELECT value, count(DISTINCT split_part(coalesce(source, ''), '/', 1)) AS n_owners FROM found GROUP BY value),
named AS (SELECT doc_id, kind, start, n_owners <= 1 AS live, concat(CASE kind WHEN 0 THEN 'assign' WHEN 1 THEN 'access' WHEN 2 THEN 'hex' ELSE 'owned' END, ':', start, ':', stop) AS span FROM found JOIN held USING (value)),
agg AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    string_agg(span, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg(span, ',' ORDER BY start, kind) FILTER (kind < 3 OR live) AS spans,
    count(*) FILTER (live) AS n_live, count(*) FILTER (kind < 3 AND NOT live) AS n_examples FROM named GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_examples, 0) AS n_examples
FROM documents LEFT JOIN agg USING (doc_id)
"""
}
QUERIES = {"op2_secret_scan": op2_secret_scan}
