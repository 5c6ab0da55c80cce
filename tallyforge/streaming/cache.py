"""A cache of selections as a stream of requests: hits renew an entry, which expires when it isn't hit for long enough."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTCOMES = "cache_key string, at timestamp, outcome string, created_at timestamp, last_hit_at timestamp, hits long"
#: The same with moments as microseconds, which no time zone can change on their way through pandas.
_PLAIN = "cache_key string, at long, outcome string, created_at long, last_hit_at long, hits long"
#: A shard's entries as one Arrow table.
_SHARD = "entries binary"
_COLUMNS = ["cache_key", "created", "used", "hits"]


class _Entries(StatefulProcessor):
    """The entries of a shard of keys: when each was made and last used (microseconds), and its hits; a timer stands at the end of the first that expires.

    A call for a key costs more than its rows do, so keys are dealt to shards, whose rows are met together.
    """

    def __init__(self, ttl_seconds: int):
        self.ttl = ttl_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.shard = handle.getValueState("shard", _SHARD)

    def _entries(self) -> pd.DataFrame:
        if not self.shard.exists():
            return pd.DataFrame({"cache_key": pd.Series([], dtype="object"), **{c: pd.Series([], dtype="i8") for c in _COLUMNS[1:]}})
        return pa.ipc.open_stream(bytes(self.shard.get()[0])).read_all().to_pandas()

    def _keep(self, entries: pd.DataFrame) -> None:
        """Entries of the shard from now on, and the timer of the first that expires."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if not len(entries):
            self.shard.clear()
            return
        schema = pa.schema([("cache_key", pa.string()), *((c, pa.int64()) for c in _COLUMNS[1:])])
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, schema) as stream:
            stream.write_table(pa.Table.from_pandas(entries[_COLUMNS], schema, preserve_index=False))
        self.shard.update((out.getvalue().to_pybytes(),))
        self.handle.registerTimer(int(self._ends(entries["used"]).min()))

    def _ends(self, used: pd.Series) -> pd.Series:
        """When entries expire, in whole milliseconds."""
        return -(-(used + self.ttl) // 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        own, new = self._entries(), pd.concat(list(rows))[["cache_key", "moment"]]
        # an entry stands before its key's requests, as if it had been asked for when it was last used
        code, names = pd.factorize(np.concatenate([own["cache_key"].to_numpy(object), new["cache_key"].to_numpy(object)]), use_na_sentinel=False)
        at = np.concatenate([own["used"].to_numpy("i8"), new["moment"].to_numpy("i8")])
        old = np.arange(len(at)) < len(own)
        made, hits = (np.concatenate([own[c].to_numpy("i8"), np.zeros(len(new), "i8")]) for c in ("created", "hits"))
        order = np.lexsort((at, ~old, code))
        code, at, old, made, hits = (x[order] for x in (code, at, old, made, hits))
        first = np.append(True, code[1:] != code[:-1])
        fresh = first.copy()
        fresh[1:] |= at[1:] - at[:-1] > self.ttl
        start = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
        hits = hits[start] + np.arange(len(at)) - start
        made = np.where(old, made, at)[start]
        name = np.asarray(names, object)[code]
        ended, last = np.flatnonzero(fresh & ~first) - 1, np.append(first[1:], True)
        asked = ~old
        yield _frame(name[asked], at[asked], np.where(fresh, "miss", "hit")[asked], made[asked], at[asked], hits[asked])
        yield _frame(name[ended], at[ended] + self.ttl, "expiry", made[ended], at[ended], hits[ended])
        self._keep(pd.DataFrame({"cache_key": name[last], "created": made[last], "used": at[last], "hits": hits[last]}))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        own = self._entries()
        over = self._ends(own["used"]) <= max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        gone = own[over]
        self._keep(own[~over])
        yield _frame(gone["cache_key"].to_numpy(object), (gone["used"] + self.ttl).to_numpy(), "expiry", *(gone[c].to_numpy() for c in _COLUMNS[1:]))

    def close(self) -> None:
        pass


def _frame(name, at, outcome, created, used, hits) -> pd.DataFrame:
    return pd.DataFrame({"cache_key": name, "at": at, "outcome": outcome, "created_at": created, "last_hit_at": used, "hits": hits})


def cached_requests(requests: DataFrame, ttl_seconds: int, late: str = "10 minutes", shards: int = 1024) -> DataFrame:
    """What a stream of requests (``cache_key``, ``at``) meets: a row of OUTCOMES for each, hit or miss, and one for each expiry.

    A request hits if its key's entry was last used ``ttl_seconds`` ago at most, and renews
    it; otherwise an entry is made.  Expiries are told once the watermark has passed them,
    or when the next request meets them.  ``created_at``, ``last_hit_at`` and ``hits`` are
    the entry's after the request.  Keys are dealt to ``shards``, whose entries a task holds
    one shard at a time; a stream keeps the number that it began with.  The session's state store must be RocksDB (:data:`ROCKS`).
    """
    shard = F.pmod(F.xxhash64("cache_key"), F.lit(shards)).cast("int")
    timed = requests.select("cache_key", "at", F.unix_micros("at").alias("moment"), shard.alias("shard")).withWatermark("at", late)
    met = timed.groupBy("shard").transformWithStateInPandas(_Entries(ttl_seconds), _PLAIN, "Append", "EventTime")
    return met.select("cache_key", F.timestamp_micros("at").alias("at"), "outcome", F.timestamp_micros("created_at").alias("created_at"), F.when(F.col("hits") > 0, F.timestamp_micros("last_hit_at")).alias("last_hit_at"), "hits")


#: The setting that stateful processors ask of the session in which their query is started.
ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
