"""Many display filters over packets in one pass.

The conditions that filters are made of (comparisons, tests of layers) are collected from all of them; one that several
filters have is worked out once, as a column, and the filters are combinations of these. Packets are
decoded once, with the columns that any filter reads.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.dissect import PACKET, dissect
from .display_filter import FIELDS, display_filter, filter_columns, tokens

#: Filters in one plan at most; more are an error, as a plan of any size can't be compiled.
MOST_FILTERS = 1000


def filters_of(table: DataFrame, id_col: str = "id", text_col: str = "text") -> dict:
    """A table of filters as a dict; ids must differ, and rows with a null id or text are left out."""
    rows = table.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).dropna().limit(MOST_FILTERS + 1).collect()
    if len(rows) > MOST_FILTERS:
        raise ValueError(f"more than {MOST_FILTERS} filters")
    out = {r.id: r.text for r in rows}
    if len(out) < len(rows):
        raise ValueError("filters with equal ids")
    return out


def matching(frames: DataFrame, filters: Mapping, columns: list[str]) -> DataFrame:
    """The given columns of frames' packets, and `matches`: ids of the filters that find the packet, in the filters' order.
    Filters that name streams need a column stream_id."""
    needs = set().union(*map(filter_columns, filters.values())) if filters else set()
    packets = dissect(frames, {*columns, *needs} & {*PACKET, *frames.columns})
    shared: dict[str, tuple[str, Column]] = {}

    def share(leaf: Column) -> Column:
        name = shared.setdefault(str(leaf), (f"_leaf{len(shared)}", leaf))[0]
        return F.col(name)

    whole = {i: display_filter(text, share) for i, text in filters.items()}
    packets = packets.select(*columns, *[leaf.alias(name) for name, leaf in shared.values()])
    if not whole:
        return packets.withColumn("matches", F.array())
    return packets.select(*columns, F.array_compact(F.array(*[F.when(c, F.lit(i)) for i, c in whole.items()])).alias("matches"))


def unknown_names(table: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """The names in each filter of a table that are no fields: id, place (from 0), name; such names never match."""

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = [(i, n, name) for i, text in zip(b["id"], b["text"], strict=True) for n, name in enumerate(t.value for t in tokens(text) if t.kind == "name" and t.value not in FIELDS)]
            yield pd.DataFrame(rows, columns=["id", "place", "name"])

    rows = table.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).dropna()
    return rows.mapInPandas(run, f"id {rows.schema['id'].dataType.simpleString()}, place int, name string")
