"""Spans of regular expressions in texts, as DataFrame expressions.

A text may hold as many spans as characters, so arrays are never appended to and no span is held against all others:
running values come from log2(n) passes that each add what stands 1, 2, 4, ... places before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: characters kept from before a match
CONTEXT = 40
#: passes of a running value: an array has fewer than 2 ** 31 elements
ROUNDS = 31
#: characters of a block that a text is cut into before parts are taken from it
BLOCK = 4096

_SPAN = "array<struct<start: long, end: long, value: string, before: string, after: string>>"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)`, with the value made once however often it is used."""
    return F.transform(F.array(value), use)[0]


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Each element joined with all before it, in their order, for an associative `join`."""
    def one(known: Column, step: Column) -> Column:
        further = F.transform(known, lambda x, i: F.when(i >= step, join(F.get(known, i - step), x)).otherwise(x))
        return F.when(step < F.size(known), further).otherwise(known)

    return F.aggregate(F.array(*(F.lit(1 << k) for k in range(ROUNDS))), values, one)


def matches(text: Column, pattern: str, needs: str | None = None) -> Column:
    """All leftmost matches that don't overlap: array of (start, end, value, before, after), in code points.

    A text without `needs`, a string that every match holds, isn't searched. The places come from the stretches between
    the matches, which the same pattern splits off.
    """
    def span(x: Column, end: Column, i: Column) -> Column:
        value = F.get(x["values"], i)
        return F.struct(
            (end - F.length(value)).alias("start"), end.alias("end"), value.alias("value"), F.right(F.get(x["gaps"], i), F.lit(CONTEXT)).alias("before"), F.left(F.get(x["gaps"], i + 1), F.lit(1)).alias("after"),
        )

    def placed(x: Column) -> Column:
        lengths = F.transform(x["values"], lambda value, i: (F.length(value) + F.length(F.get(x["gaps"], i))).cast("long"))
        return F.transform(running(lengths, lambda a, b: a + b), lambda end, i: span(x, end, i))

    # bound to a name, so that each is made once for a text
    both = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("values"))
    here = text.rlike(pattern)
    if needs:
        here = text.contains(needs) & here
    return F.when(here, bound(both, placed)).otherwise(F.expr(f"cast(array() as {_SPAN})"))


def unblocked(spans: Column, ranks: int, until: Callable[[Column], Column] = lambda c: c["end"]) -> Column:
    """Spans that are `base`, or that no base span and none of a lower rank overlaps, in no order.

    A span overlaps what begins before `until(span)` and ends after its start. For each rank, starts and ends are sorted
    into one row, along which the greatest end so far is carried: it tells whether anything reaches into a span.
    """
    def free(kept: Column, rank: int) -> Column:
        own = F.filter(kept, lambda c: ~c["base"] & (c["rank"] == rank))
        others = F.filter(kept, lambda c: c["base"] | (c["rank"] < rank))

        def alone(both: Column) -> Column:
            # at one place the spans that end there come before those that begin
            asks = F.transform(both["own"], lambda c, i: F.struct(until(c).alias("at"), F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("reach"), i.cast("int").alias("which")))
            begins = F.transform(both["others"], lambda c: F.struct(c["start"].alias("at"), F.lit(1).alias("kind"), c["end"].alias("reach"), F.lit(-1).alias("which")))
            return bound(F.array_sort(F.concat(asks, begins)), lambda events: bound(
                F.struct(running(F.transform(events, lambda e: e["reach"]), F.greatest).alias("reach"), events.alias("events")),
                lambda x: F.transform(
                    F.filter(
                        F.transform(x["events"], lambda e, i: F.struct(e["which"].alias("which"), F.get(x["reach"], i).alias("reach"))),
                        lambda e: (e["which"] >= 0) & (e["reach"] <= F.get(both["own"], e["which"])["start"]),
                    ),
                    lambda e: F.get(both["own"], e["which"]),
                ),
            ))

        some = bound(F.struct(own.alias("own"), others.alias("others")), lambda both: F.when(F.size(both["others"]) == 0, both["own"]).otherwise(alone(both)))
        return F.when(F.exists(kept, lambda c: ~c["base"] & (c["rank"] == rank)), some).otherwise(F.filter(kept, lambda c: F.lit(False)))

    return bound(spans, lambda kept: F.when(
        F.exists(kept, lambda c: ~c["base"]), F.concat(F.filter(kept, lambda c: c["base"]), *(free(kept, rank) for rank in range(ranks))),
    ).otherwise(kept))


def cut_blocks(text: Column) -> Column:
    """The text in blocks of BLOCK characters: a part far down a long text is then found without reading what comes before."""
    last = F.floor((F.greatest(F.length(text), F.lit(1)) - 1) / BLOCK).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substr(text, i * BLOCK + 1, F.lit(BLOCK)))


def part(blocks: Column, start: Column, end: Column) -> Column:
    """Characters start to end of a text in blocks."""
    first = F.floor(start / BLOCK).cast("int")
    many = F.floor(F.greatest(end - 1, start) / BLOCK).cast("int") - first + 1
    near = F.when(many == 1, F.get(blocks, first)).otherwise(F.array_join(F.slice(blocks, first + 1, many), ""))
    return F.when(end > start, F.substr(near, (start - first * BLOCK + 1).cast("int"), (end - start).cast("int"))).otherwise("")


def rendered(spans: Column) -> Column:
    """kind:start:end, joined by commas, of (start, rank, end, kind) structs in their order."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def sha(text: Column) -> Column:
    return F.sha2(text, 256)
