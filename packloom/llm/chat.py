"""Chat formatting: quotations link messages to the ones they answer.

Every line has a quote level, its leading ">" signs. A passage is a run of lines of one
level. Passages and their lines are normalised and hashed, and joined to the first message
of the conversation that wrote the same text itself; of the lowest quote level that finds any
(deeper ones quote its ancestors), the message whose text a reply quotes most is its parent. Conversations are then put in reply order (each message followed by
the answers to it, in turn order), without the quotes. DataFrame functions only.

No step gathers a conversation in one task, and no row grows with it. A thread's order is the order
in which a walk around it enters its messages: each message has two ends, where the walk enters and
where it leaves, each end knows the next one, and pointer doubling counts how many messages are
entered from there on. A range sort then numbers the messages, and a long conversation is written in
parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stored, grown, numbered, table

#: Messages in one row of the result; a longer conversation has several parts.
PART_MESSAGES = 1000

_QUOTE = r"^[ \t]*((?:>[ \t]?)+)"
_WROTE = r"(?i)^\s*on\b.*\bwrote:\s*$"


def _lines(text: Column) -> Column:
    """(level, body) of every line."""
    def parsed(line):
        marks = F.regexp_extract(line, _QUOTE, 1)
        return F.struct(F.length(F.regexp_replace(marks, "[^>]", "")).alias("level"), F.regexp_replace(line, _QUOTE, "").alias("body"))

    return F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n", -1), parsed)


def _passages(lines: Column) -> Column:
    """Runs of lines of one level, as (level, lines)."""

    def cut(starts):
        def passage(start, k):
            past = F.coalesce(F.get(starts, k + 1), F.size(lines) + 1)
            return F.struct(F.element_at(lines, start)["level"].alias("level"), F.transform(F.slice(lines, start, past - start), lambda x: x["body"]).alias("lines"))

        return F.transform(starts, passage)

    new = lambda i: (i == 1) | (F.element_at(lines, i)["level"] != F.get(lines, i - 2)["level"])
    starts = F.filter(F.sequence(F.lit(1), F.size(lines)), new)
    # A variable of a lambda stands for the starts, which so are found once.
    return F.get(F.transform(F.array(starts), cut), F.lit(0))


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _units(passages: Column, quoted: bool) -> Column:
    """(level, text) of the normalised passages, quoted or own, and of their lines, without empty ones.
    Repeats stay here: Spark compares structs in an array pair by pair; aggregates take them together."""
    some = F.filter(passages, lambda p: (p["level"] > 0) == F.lit(quoted))
    unit = lambda p, text: F.struct(p["level"].alias("level"), text.alias("text"))
    whole = F.transform(some, lambda p: unit(p, _normal(F.array_join(p["lines"], " "))))
    each = F.flatten(F.transform(some, lambda p: F.transform(p["lines"], lambda line: unit(p, _normal(line)))))
    return F.filter(F.concat(whole, each), lambda u: u["text"] != "")


def _body(lines: Column) -> Column:
    """The message's own lines, without the line that introduces a quotation."""
    own = F.filter(lines, lambda x, i: (x["level"] == 0) & ~(x["body"].rlike(_WROTE) & (F.coalesce(F.get(lines, i + 1)["level"], F.lit(0)) > 0)))
    return F.trim(F.regexp_replace(F.array_join(F.transform(own, lambda x: x["body"]), "\n"), r"\n{3,}", "\n\n"), F.lit("\n "))


def link_quotations(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per row of `messages`: conv_id, turn, role, body (without quotes), parent
    (the turn it answers, or null), root (the first turn of its thread) and place (how many messages
    of the thread stand before it in reply order).

    A parent is always an earlier turn of the same conversation. Of parents quoted at one level equally
    much the later one counts. A null text is an empty message; a null role is "unknown"; a
    message without a turn links to nothing and stands last; messages without a conversation
    are one conversation with a null id. Rows that repeat a turn stay and are one target."""
    kept = Stored(messages.sparkSession, "chat")
    read = messages.select(
        F.col(conv_col).alias("conv_id"), F.coalesce(F.concat(F.lit("="), F.col(conv_col).cast("string")), F.lit("")).alias("conv"),
        F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("unknown")).alias("role"), _lines(F.col(text_col)).alias("lines"),
    ).withColumn("passages", _passages(F.col("lines")))
    quotes = F.exists("lines", lambda x: x["level"] > 0)
    parsed = kept.put(read.select("conv_id", "conv", "turn", "role", _body(F.col("lines")).alias("body"), F.when(quotes, _units(F.col("passages"), True)).alias("quoted"), _units(F.col("passages"), False).alias("own")))

    hashed = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias("unit")
    asked = parsed.filter("quoted is not null and turn is not null").select("conv", "turn", F.explode("quoted").alias("u")).select("conv", "turn", "u.level", hashed("u.text"), F.length("u.text").alias("weight"))
    asked = kept.put(asked.distinct())
    # Only conversations with quotations are indexed, and of equal texts the first.
    index = parsed.filter("turn is not null").join(grown(asked.select("conv").distinct()), "conv", "left_semi").select("conv", "turn", F.explode("own").alias("u")).select("conv", hashed("u.text"), "turn")
    index = kept.put(index.groupBy("conv", "unit").agg(F.min("turn").alias("source")))
    votes = asked.join(grown(index), ["conv", "unit"]).filter("source < turn").groupBy("conv", "turn", "level", "source").agg(F.sum("weight").alias("weight"))
    links = votes.groupBy("conv", "turn").agg(F.max_by("source", F.struct(-F.col("level"), "weight", "source")).alias("parent"))
    links = kept.put(links.select("conv", "turn", "parent"))
    places = _places(links, kept)
    alone = F.coalesce("turn", F.lit((1 << 63) - 1))
    return parsed.join(grown(places), ["conv", "turn"], "left").select("conv_id", "conv", "turn", "role", "body", "parent", F.coalesce("root", alone).alias("root"), F.coalesce("place", F.lit(0).cast("long")).alias("place"))


def _followed(rows: DataFrame, key: list[str], to: list[str], kept: Stored, step) -> DataFrame:
    """Pointer doubling: while a row has a next one, `step` makes it point where that one points."""
    while not rows.filter(f"{to[0]} is not null").isEmpty():
        ahead = rows.select("conv", *[F.col(k).alias(t) for k, t in zip(key, to, strict=True)], *[F.col(c).alias("_" + c) for c in rows.columns if c != "conv" and c not in key])
        moved = rows.filter(f"{to[0]} is not null").join(grown(ahead), ["conv", *to])
        old, rows = rows, kept.put(rows.filter(f"{to[0]} is null").unionByName(step(moved).select(*rows.columns)))
        kept.drop(old)
    return rows


def _places(links: DataFrame, kept: Stored) -> DataFrame:
    """(conv, turn, parent, root, place) of the messages of threads, from (conv, turn, parent)."""
    threads = links.select("conv", "turn", "parent").unionByName(links.select("conv", F.col("parent").alias("turn"), F.lit(None).cast("long").alias("parent")))
    threads = kept.put(threads.groupBy("conv", "turn").agg(F.max("parent").alias("parent")))
    if threads.isEmpty():
        return threads.select("conv", "turn", "parent", F.col("turn").alias("root"), F.lit(0).cast("long").alias("place"))
    roots = _followed(kept.put(threads.select("conv", "turn", F.col("parent").alias("up"), F.coalesce("parent", "turn").alias("root"))), ["turn"], ["up"], kept, lambda m: m.select("conv", "turn", F.col("_up").alias("up"), F.col("_root").alias("root")))

    # Answers to one message, numbered in turn order, so that each knows the one after it.
    answers = threads.filter("parent is not null").select("conv", "turn", "parent", F.concat_ws(" ", "conv", F.col("parent").cast("string")).alias("of"))
    answers = numbered(answers, "of", ["turn"], kept)
    after = answers.select("of", (F.col("rank") - 1).alias("rank"), F.col("turn").alias("sibling"))
    answers = kept.put(answers.join(grown(after), ["of", "rank"], "left").select("conv", "turn", "parent", "sibling", "rank"))
    firsts = answers.filter("rank = 0").select("conv", F.col("parent").alias("turn"), F.col("turn").alias("child"))
    enter = threads.join(grown(firsts), ["conv", "turn"], "left").select("conv", "turn", F.lit(0).alias("side"), F.coalesce("child", "turn").alias("to"), F.when(F.col("child").isNull(), 1).otherwise(0).alias("to_side"), F.lit(1).cast("long").alias("entered"))
    leave = threads.join(grown(answers.select("conv", "turn", "sibling")), ["conv", "turn"], "left").select("conv", "turn", F.lit(1).alias("side"), F.coalesce("sibling", "parent").alias("to"), F.when(F.col("sibling").isNull(), 1).otherwise(0).alias("to_side"), F.lit(0).cast("long").alias("entered"))
    walk = kept.put(enter.unionByName(leave))
    walk = _followed(walk, ["turn", "side"], ["to", "to_side"], kept, lambda m: m.select("conv", "turn", "side", F.col("_to").alias("to"), F.col("_to_side").alias("to_side"), (F.col("entered") + F.col("_entered")).alias("entered")))
    entered = walk.filter("side = 0").select("conv", "turn", "entered")
    mine = roots.select("conv", "turn", "root").join(grown(entered), ["conv", "turn"])
    whole = mine.filter("turn = root").select("conv", "root", F.col("entered").alias("size"))
    placed = mine.join(grown(whole), ["conv", "root"]).select("conv", "turn", "root", (F.col("size") - F.col("entered")).alias("place"))
    return kept.put(threads.join(grown(placed), ["conv", "turn"]).select("conv", "turn", "parent", "root", "place"))


def format_chats(messages: DataFrame, part_messages: int = PART_MESSAGES, template: str = "<|{role}|>\n{body}\n<|end|>\n", **columns) -> DataFrame:
    """Conversations in reply order: conv_id, part, n_messages, turns, parents (comma-joined,
    "-" for none), text. Part k has the messages from k * part_messages on. See
    link_quotations() for nulls, repeats and `columns`; no messages give no rows."""
    kept = Stored(messages.sparkSession, "chat-order")
    before, _, rest = template.partition("{role}")
    between, _, after = rest.partition("{body}")
    linked = link_quotations(messages, **columns)
    placed = numbered(linked, "conv", ["root", "place", "turn"], kept, "position")
    segment = F.concat(F.lit(before), "role", F.lit(between), "body", F.lit(after))
    item = F.struct("position", F.coalesce(F.col("turn").cast("string"), F.lit("-")).alias("turn"), F.coalesce(F.col("parent").cast("string"), F.lit("-")).alias("parent"), segment.alias("segment"))
    rows = placed.select("conv", "conv_id", F.floor(F.col("position") / part_messages).cast("long").alias("part"), item.alias("m"))
    grouped = rows.groupBy("conv", "part").agg(F.first("conv_id").alias("conv_id"), F.array_sort(F.collect_list("m")).alias("m"))
    joined = lambda field, by: F.array_join(F.transform("m", lambda x: x[field]), by)
    return grouped.select("conv_id", "part", F.size("m").cast("long").alias("n_messages"), joined("turn", ",").alias("turns"), joined("parent", ",").alias("parents"), joined("segment", "").alias("text"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


QUERIES = {"op7_chat_formatting": op7_chat_formatting}
ORACLE_SQL: dict[str, str] = {}
