"""Interleave sources by target weights with Pfair schedules.

The documents of a source, in order of their ids, are one stream, cut into blocks
of equal size.  With integer parts per source the weights are fractions of the
period, the sum of the parts.  Block j of a source of weight w may not start before
slot floor(j / w) and must be done by slot ceil((j + 1) / w); earliest deadline first
keeps all these windows, so at any time a source is less than one block away from
its share.  Windows repeat with the period, hence one period (at most ``MAX_PERIOD``
slots) is scheduled and every block finds its slot by arithmetic.

The schedule ends when every source has been used in full.  Sources that are
smaller than their weight asks for start again (another epoch); none is cut.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.functions.running import ordered_totals
from stockloom.llm.common import fresh, text_or_empty

BLOCK = 1 << 16
PERIOD = 1000
EXPONENT = 0.75
MAX_PERIOD = 1 << 16
MAX_SOURCES = 10_000


def period_slots(parts: Sequence[int]) -> list[list[int]]:
    """Per source the slots of its blocks in one period, by earliest deadline first.

    Ties of deadlines go to the source that comes first.
    """
    period = sum(parts)
    released: list[list[int]] = [[] for _ in range(period)]
    for source, n in enumerate(parts):
        for j in range(n):
            released[j * period // n].append(source)
    slots: list[list[int]] = [[] for _ in parts]
    ready: list[tuple[int, int]] = []
    begun = [0] * len(parts)
    for t in range(period):
        for source in released[t]:
            begun[source] += 1
            heapq.heappush(ready, (-(-begun[source] * period // parts[source]), source))
        _, source = heapq.heappop(ready)
        slots[source].append(t)
    return slots


def tempered_parts(sizes: Mapping[str, int], exponent: float = EXPONENT, period: int = PERIOD) -> dict[str, int]:
    """Parts in proportion to size ** exponent, about ``period`` in all and at least one each."""
    weights = {name: float(size) ** exponent for name, size in sizes.items()}
    whole = sum(weights[name] for name in sorted(weights)) or 1.0
    return {name: max(1, int(period * weight / whole + 0.5)) for name, weight in weights.items()}


def _source_key(source: Column) -> Column:
    """Rows without a source are a source of their own."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def mixture_schedule(
    docs: DataFrame,
    parts: Mapping[str | None, int] | None = None,
    block: int = BLOCK,
    exponent: float = EXPONENT,
    period: int = PERIOD,
    id_column: str = "doc_id",
    source_column: str = "source",
    text_column: str = "text",
) -> DataFrame:
    """(doc_id, source, size, copies, start, block, epoch, slot): where each document comes.

    ``size`` is the text's number of code points, ``start`` its place in the stream of
    its source, ``block`` the block in which it starts.  ``parts`` gives the target
    weights; by default they follow ``tempered_parts`` of the sources' sizes.  The
    number of sources is limited to ``MAX_SOURCES``, that of slots in a period to
    ``MAX_PERIOD``; beyond, a ValueError is raised.

    Null texts are empty; null sources are one source; documents without an id come
    first in theirs; rows that share source and id are one entry with the number of
    ``copies``; an empty table gives no rows.
    """
    entries = (
        docs.select(
            docs[id_column].alias("doc_id"),
            docs[source_column].alias("source"),
            _source_key(docs[source_column]).alias("key"),
            F.length(text_or_empty(docs[text_column])).cast("long").alias("chars"),
        )
        .groupBy("key", "source", "doc_id")
        .agg(F.sum("chars").alias("size"), F.count(F.lit(1)).alias("copies"))
    )
    placed = ordered_totals(
        entries, [F.col("key").asc(), F.col("doc_id").asc_nulls_first()], {"upto": "size"}
    ).withColumn("before", F.col("upto") - F.col("size"))
    totals = placed.groupBy("key").agg(F.sum("size").alias("total"), F.min("before").alias("begin"))
    rows = sorted(totals.limit(MAX_SOURCES + 1).collect(), key=lambda row: row["key"])
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    keys = [row["key"] for row in rows]
    sizes = {row["key"]: row["total"] for row in rows}
    if parts is None:
        share = tempered_parts(sizes, exponent, period)
    else:
        share = {"n" if name is None else f"s{name}": n for name, n in parts.items()}
        if missing := [key for key in keys if share.get(key, 0) < 1]:
            raise ValueError(f"no weight for sources {missing[:5]}")
    counts = [share[key] for key in keys]
    length = sum(counts)
    if length > MAX_PERIOD:
        raise ValueError(f"a period of {length} slots is longer than {MAX_PERIOD}")
    slots = period_slots(counts)
    blocks = [max(1, -(-sizes[key] // block)) for key in keys]
    ends = [(m - 1) // n * length + slots[i][(m - 1) % n] + 1 for i, (m, n) in enumerate(zip(blocks, counts))]
    stop = max(ends, default=0)
    plan = [
        (key, rows[i]["begin"], counts[i], blocks[i], slots[i],
         stop // max(1, length) * counts[i] + sum(s < stop % max(1, length) for s in slots[i]))
        for i, key in enumerate(keys)
    ]
    kind = "of_key string, begin long, n long, blocks long, slots array<long>, granted long"
    # One row per source and one number per slot of the period: both bounded above.
    sources = F.broadcast(docs.sparkSession.createDataFrame(plan, kind))
    number = F.col("epoch") * F.col("blocks") + F.col("block")
    return (
        placed.join(sources, F.col("key") == F.col("of_key"))
        .withColumn("start", F.col("before") - F.col("begin"))
        .withColumn("block", F.least(F.floor(F.col("start") / block), F.col("blocks") - 1))
        .withColumn(
            "epoch",
            F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("granted") - 1 - F.col("block")) / F.col("blocks")))),
        )
        .select(
            "doc_id",
            "source",
            "size",
            "copies",
            "start",
            "block",
            "epoch",
            (F.floor(number / F.col("n")) * length + F.get("slots", (number % F.col("n")).cast("int"))).alias("slot"),
        )
    )


def mix_sources(docs: DataFrame, id_column: str = "doc_id", source_column: str = "source", **options) -> DataFrame:
    """The rows of ``docs`` in mixed order, each as often as its epochs, columns unchanged.

    Rows are range-partitioned and sorted by slot, so files written from the result
    hold the mixture in order.  Rows that share source and id move together.
    """
    schedule = mixture_schedule(docs, id_column=id_column, source_column=source_column, **options)
    wanted = schedule.groupBy("source", "doc_id").agg(
        F.collect_list(F.struct("slot", "start")).alias("turns")
    )
    names = {name: fresh(docs, f"_{name}") for name in ("mix_source", "mix_id", "mix_turns", "mix_turn")}
    wanted = wanted.select(
        F.col("source").alias(names["mix_source"]), F.col("doc_id").alias(names["mix_id"]), F.col("turns").alias(names["mix_turns"])
    )
    same = docs[source_column].eqNullSafe(F.col(names["mix_source"])) & docs[id_column].eqNullSafe(F.col(names["mix_id"]))
    turn = F.col(names["mix_turn"])
    return (
        docs.join(wanted, same)
        .select(*[docs[c] for c in docs.columns], F.explode(names["mix_turns"]).alias(names["mix_turn"]))
        .repartitionByRange(turn["slot"], F.col(source_column), turn["start"])
        .sortWithinPartitions(turn["slot"], F.col(source_column), turn["start"])
        .drop(names["mix_turn"])
    )
