"""The live image of a table, kept equal to its log so far, in tiers by buckets of keys.

Batches are written as small deltas and folded when read, so a trigger costs what it brings and not
what the table holds. From time to time the deltas are folded, and only the buckets that they touch:
first into a tier of the bucket, and when that has grown to a share of the bucket's base, into a new
base for it. Buckets that nothing touches keep their base. Each row carries the position it comes
from and the highest position wins, hence a repeated batch, or one out of order, changes nothing.

    <root>/delta/batch=<id>              the last event per key of one batch, with its bucket
    <root>/tier/upto=<id>                events since the base of the buckets folded then, with their bucket
    <root>/base/upto=<id>/bucket=<b>     the bucket's rows, folded
    <root>/state/upto=<id>/state.json    which of these make up the image; one entry for each bucket

A delta or a tier is few files for all its buckets, as a trigger that brings little would else spend its
time on many small ones. What a fold replaces is removed at the fold after it, so that a reader of the
state before is served.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from tidemark.operators.ordered import plan_bytes
from tidemark.operators.restore import BROADCAST_BYTES, BROADCAST_KEYS, Key, key_columns, latest_events
from tidemark.session import delete_folder, read_text, write_text
from tidemark.streaming.versions import finished

# a tier of so many rows for each row of its base is folded into it
FOLD_SHARE = 0.1


class LiveImage:
    def __init__(self, spark: SparkSession, root: str, key: Key, payload: Sequence[str], compact_every: int = 20, buckets: int = 64):
        """`buckets` counts for a new image; one that is there keeps its own number."""
        self.spark, self.root, self.keys = spark, root, key_columns(key)
        self.payload, self.compact_every, self.buckets = list(payload), compact_every, buckets

    def load_base(self, snapshot: DataFrame) -> None:
        """Begin from a snapshot; its rows come before any event."""
        zero = {"log_no": F.lit(0), "log_pos": F.lit(0).cast("long"), "sub": F.lit(0), "op": F.lit("I")}
        rows = snapshot.select(*self.keys, *self.payload).withColumns(zero)
        base = {b: [-1, n] for b, n in self._write(rows, "base", -1).items()}
        self._keep({"upto": -1, "buckets": self.buckets, "schema": rows.schema.json(), "base": base, "tier": {}, "stale": []})

    def start(self, changes: DataFrame, checkpoint: str) -> StreamingQuery:
        return (
            changes.writeStream.foreachBatch(self.apply)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        events = latest_events(batch, self.keys, self.payload)
        if self._state() is None:
            self._keep({"upto": -1, "buckets": self.buckets, "schema": events.schema.json(), "base": {}, "tier": {}, "stale": []})
        self._store(events, f"delta/batch={batch_id}")
        if (batch_id + 1) % self.compact_every == 0:
            self.compact(batch_id)

    def compact(self, upto: int) -> None:
        """Fold the deltas up to a batch; deletes stay, so that an older event arriving later cannot bring a row back.

        A tier's rows are at most those before and the news; they are counted once that bound has reached the share.
        """
        state = self._state()
        if state is None or upto <= state["upto"]:
            return
        deltas = self._deltas(state, upto)
        base, tier, wide = dict(state["base"]), dict(state["tier"]), dict(state.get("wide", {}))
        news, stale = self._counts(deltas, state), list(deltas)
        if news:
            touched = {*news, *self._thinned(tier, wide)}
            new = [self._read_stored(folder, state) for folder in deltas] + self._tiers(tier, touched, state)
            self._store(self._fold(reduce(DataFrame.unionByName, new)), f"tier/upto={upto}")
            tier |= {b: [upto, tier.get(b, [0, 0])[1] + news.get(b, 0)] for b in touched}
            wide[str(upto)] = len(touched)

            def grown() -> list[str]:
                return sorted(b for b in touched if tier[b][1] >= FOLD_SHARE * base.get(b, [0, 0])[1])

            if grown():
                tier |= {b: [upto, n] for b, n in self._counts([f"tier/upto={upto}"], state).items()}
            if own := grown():
                rows = reduce(DataFrame.unionByName, [self._read(self._paths("base", base, own), state), *self._tiers(tier, own, state)])
                counts = self._write(self._fold(rows), "base", upto)
                stale += [f"base/upto={base[b][0]}/bucket={b}" for b in own if b in base]
                base |= {b: [upto, n] for b, n in counts.items()}
                tier = {b: v for b, v in tier.items() if b not in own}
            left = {str(at) for at, _ in tier.values()}
            stale += [f"tier/upto={at}" for at in {*wide, *(str(at) for at, _ in state["tier"].values())} - left]
            wide = {at: n for at, n in wide.items() if at in left}
        self._keep(state | {"upto": upto, "base": base, "tier": tier, "wide": wide, "stale": stale})
        for path in [*state["stale"], f"state/upto={state['upto']}"]:
            delete_folder(self.spark, f"{self.root}/{path}")

    def read(self) -> DataFrame:
        return self._events().filter(F.col("op") != "D").select(*self.keys, *self.payload)

    def _events(self) -> DataFrame:
        """Buckets without news as they are, and the others with theirs laid over them."""
        state = self._state()
        if state is None:
            raise ValueError("neither a base nor a batch has been written")
        deltas = self._deltas(state)
        touched = {*self._counts(deltas, state), *state["tier"]}
        quiet = self._paths("base", state["base"], set(state["base"]) - touched)
        old = self._paths("base", state["base"], touched)
        if not touched:
            return self._read(quiet, state)
        fresh = reduce(DataFrame.unionByName, [self._read_stored(folder, state) for folder in deltas] + self._tiers(state["tier"], state["tier"], state))
        rows = self._lay_over(self._read(old, state), fresh) if old else self._fold(fresh)
        return rows.unionByName(self._read(quiet, state)) if quiet else rows

    def _fold(self, events: DataFrame) -> DataFrame:
        return latest_events(events, self.keys, self.payload)

    def _lay_over(self, old: DataFrame, new: DataFrame) -> DataFrame:
        """Few changed keys, counted, are broadcast, and the rows they do not touch stay where they
        are; otherwise all rows meet in one aggregate."""
        keys = new.select(*self.keys).distinct()
        if plan_bytes(keys) > BROADCAST_BYTES or keys.limit(BROADCAST_KEYS + 1).count() > BROADCAST_KEYS:
            return self._fold(old.unionByName(new))
        keys = F.broadcast(keys)
        touched = old.join(keys, self.keys, "left_semi")
        untouched = old.join(keys, self.keys, "left_anti")
        return untouched.unionByName(self._fold(touched.select(new.columns).unionByName(new)))

    # ---- files

    def _bucket(self) -> Column:
        return F.pmod(F.hash(*self.keys), F.lit(self.buckets))

    def _store(self, rows: DataFrame, folder: str) -> None:
        """Write rows with their bucket, as few files as their size asks for."""
        writer = rows.withColumn("bucket", self._bucket()).sortWithinPartitions("bucket").write.mode("overwrite")
        for key in self.keys:
            writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true")
        writer.parquet(f"{self.root}/{folder}")

    def _stored(self, folder: str, state: dict) -> DataFrame:
        """What `_store` wrote; the bucket may also be told by folders."""
        fields = StructType.fromJson(json.loads(state["schema"])).fields
        return self.spark.read.schema(StructType([*fields, StructField("bucket", IntegerType())])).parquet(f"{self.root}/{folder}")

    def _read_stored(self, folder: str, state: dict, buckets: Iterable[str] | None = None) -> DataFrame:
        rows = self._stored(folder, state)
        return (rows if buckets is None else rows.filter(F.col("bucket").isin(sorted(map(int, buckets))))).drop("bucket")

    def _tiers(self, tier: dict[str, list[int]], buckets: Iterable[str], state: dict) -> list[DataFrame]:
        """The rows of some buckets' tiers, by the folders that hold them."""
        by_folder: dict[int, list[str]] = {}
        for b in buckets:
            if b in tier:
                by_folder.setdefault(tier[b][0], []).append(b)
        return [self._read_stored(f"tier/upto={at}", state, own) for at, own in sorted(by_folder.items())]

    def _thinned(self, tier: dict[str, list[int]], wide: dict[str, int]) -> list[str]:
        """Buckets of tiers that hold less than half of what they were written for: the others' rows there are dead."""
        held: dict[str, list[str]] = {}
        for b, (at, _) in tier.items():
            held.setdefault(str(at), []).append(b)
        return [b for at, own in held.items() if 2 * len(own) < wide.get(at, 0) for b in own]

    def _counts(self, folders: Sequence[str], state: dict) -> dict[str, int]:
        """The rows of each bucket that has some."""
        if not folders:
            return {}
        buckets = reduce(DataFrame.unionByName, [self._stored(folder, state).select("bucket") for folder in folders])
        return {str(r["bucket"]): r["count"] for r in buckets.groupBy("bucket").count().collect()}

    def _write(self, rows: DataFrame, tier: str, upto: int) -> dict[str, int]:
        """Write rows by bucket; the rows of each bucket that has some."""
        path = f"{self.root}/{tier}/upto={upto}"
        writer = rows.withColumn("bucket", self._bucket()).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket")
        for key in self.keys:  # a look-up of one key then skips most files
            writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true")
        writer.parquet(path)
        stored = self.spark.read.schema(StructType([*rows.schema.fields, StructField("bucket", IntegerType())])).parquet(path)
        return {str(r["bucket"]): r["count"] for r in stored.groupBy("bucket").count().collect()}

    def _read(self, paths: Iterable[str], state: dict) -> DataFrame:
        schema = StructType.fromJson(json.loads(state["schema"]))
        paths = list(paths)
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _paths(self, tier: str, held: dict[str, list[int]], buckets: Iterable[str]) -> list[str]:
        return [f"{self.root}/{tier}/upto={held[b][0]}/bucket={b}" for b in sorted(buckets) if b in held]

    def _deltas(self, state: dict, upto: int | None = None) -> list[str]:
        """The deltas that are not folded yet."""
        numbers = finished(self.spark, f"{self.root}/delta/batch")
        return [f"delta/batch={n}" for n in numbers if n > state["upto"] and (upto is None or n <= upto)]

    def _state(self) -> dict | None:
        there = finished(self.spark, f"{self.root}/state/upto")
        if not there:
            return None
        state = json.loads(read_text(self.spark, f"{self.root}/state/upto={there[-1]}/state.json"))
        self.buckets = state["buckets"]
        return state

    def _keep(self, state: dict) -> None:
        """The state, and then the marker that it is whole."""
        path = f"{self.root}/state/upto={state['upto']}"
        write_text(self.spark, f"{path}/state.json", json.dumps(state))
        write_text(self.spark, f"{path}/_SUCCESS", "")
