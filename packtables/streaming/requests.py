"""Request streams: pack reuse within a TTL (T5), enrichment of a request
stream (T6) and the request log rollup (A4)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from packtables.operators.joins import null_safe_join
from packtables.session import cut_lineage


def ttl_compiles(requests: DataFrame, key: str = "fingerprint", ts: str = "ts", order: str = "seq",
                 ttl_seconds: int = 300) -> DataFrame:
    """T5 (batch twin): which requests compile a pack and which reuse one.

    A key compiles at its first request; a later request reuses the pack
    while ``ts <= t0 + ttl`` (``t0`` = last compile; hits do not extend the
    life), else it compiles again. ``order`` must be unique per key; a null
    key is a key like any other.

    The chain of compiles is a pointer chain ``i -> next(i)`` (first request
    after ``ts_i + ttl``). Positions come from one running count over the
    requests merged with probe rows at ``ts_i + ttl`` (``scan.running_sum``:
    a key with a large share of all requests is split over tasks). A request
    more than the TTL after its predecessor always compiles, so it heads a
    segment of its own, and most segments are settled at once. Only pointers
    inside longer segments are doubled: log2(longest chain of a segment)
    rounds of equi-joins on ``(key, position)``, no per-key loop and no
    collected groups. Adds ``compiled`` (bool) and ``served_by`` (the
    ``order`` value of the request whose compiled pack this one is given).
    """
    from packtables.operators.scan import running_sum

    us = F.unix_micros(F.col(ts).cast("timestamp"))
    base = requests.select(key, order, us.alias("_t"))
    events = base.select(key, order, "_t", F.lit(0).alias("_kind"), F.lit(1).alias("_one"))
    probes = base.select(key, order, (F.col("_t") + ttl_seconds * 1_000_000).alias("_t"), F.lit(1).alias("_kind"),
                         F.lit(0).alias("_one"))
    counted = running_sum(events.unionByName(probes), [key], ["_t", "_kind", order], "_one", "_run")
    pos = (counted.groupBy(key, order)
           .agg(F.max(F.when(F.col("_kind") == 0, F.col("_run"))).alias("_idx"),
                F.max(F.when(F.col("_kind") == 1, F.col("_run") + 1)).alias("_nxt")))
    pos = cut_lineage(pos)
    # the predecessor's pointer tells whether a request heads a segment
    before = pos.select(key, (F.col("_idx") + 1).alias("_idx"), F.col("_nxt").alias("_from"))
    pos = null_safe_join(pos, before, [key, "_idx"], "left").withColumn(
        "_head", (F.col("_idx") == 1) | (F.col("_from") == F.col("_idx"))).drop("_from")
    r = cut_lineage(null_safe_join(requests, pos, [key, order]))
    reached = r.filter("_head").select(key, F.col("_idx").alias("i"))
    inner = r.filter(~F.col("_head")).select(key, F.col("_idx").alias("j"))
    jump = cut_lineage(null_safe_join(r.select(key, F.col("_idx").alias("i"), F.col("_nxt").alias("j")), inner, [key, "j"],
                                      "left_semi"))
    while not jump.isEmpty():
        step = null_safe_join(reached, jump, [key, "i"]).select(key, F.col("j").alias("i"))
        reached = cut_lineage(reached.unionByName(step).distinct())
        # jump_{k+1}(i) = jump_k(jump_k(i)); pointers that leave the segment end there
        jump = cut_lineage(null_safe_join(jump.select(key, F.col("i").alias("i0"), F.col("j").alias("i")), jump, [key, "i"])
                           .select(key, F.col("i0").alias("i"), "j"))
    out = null_safe_join(r, reached.withColumnRenamed("i", "_idx").withColumn("compiled", F.lit(True)), [key, "_idx"], "left")
    out = out.withColumn("compiled", F.coalesce("compiled", F.lit(False)))
    # served_by: the request whose compile this one reuses (itself when it compiles).
    # The running count of compiles numbers them; a request takes the compile with its number.
    out = running_sum(out, [key], ["_idx"], F.col("compiled").cast("int"), "_cno")
    firsts = out.filter("compiled").select(key, "_cno", F.col(order).alias("served_by"))
    return null_safe_join(out, firsts, [key, "_cno"]).drop("_idx", "_nxt", "_head", "_cno")


def compile_reusing(inp, opts=None, ts: str = "ts", index_version: str = "") -> DataFrame:
    """T5 + B7: one row per request with the pack it is given, compiling each pack once per TTL.

    Requests share a pack only within a repository, an index version and a
    prompt fingerprint. Only the requests that compile go through
    ``compile_packs``; the others are joined with the pack of ``served_by``.
    ``inp.signals`` needs the request time ``ts``.
    """
    from dataclasses import replace

    from packtables.options import PackOptions
    from packtables.plans.packs import compile_packs

    opts = opts or PackOptions()
    keyed = inp.signals.withColumn("_pack_key", F.struct("repo_id", F.lit(index_version).alias("version"), "fingerprint"))
    served = cut_lineage(ttl_compiles(keyed, key="_pack_key", ts=ts, order="request_id", ttl_seconds=opts.cache_ttl_seconds))
    own = served.filter("compiled").select(*inp.signals.columns)
    packs = compile_packs(replace(inp, signals=own), opts).withColumnRenamed("request_id", "served_by")
    return served.select("request_id", "compiled", "served_by").join(packs, "served_by")


def _ttl_processor(names: list[str], ttl_seconds: int, order: str | None):
    """State of a key: the time of its last compile, and the requests that the watermark has not passed yet."""
    import pickle

    from pyspark.sql.streaming import StatefulProcessor

    class Reuse(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.last = handle.getValueState("last", "us long")
            self.waiting = handle.getListState("waiting", "us long, row binary")

        def handleInputRows(self, key, rows, timerValues):
            """Requests wait until no earlier one can come; nothing is decided on arrival."""
            first = None
            for pdf in rows:
                us = [pd.Timestamp(t).value // 1000 for t in pdf["ts"]]
                if us:
                    self.waiting.appendList([(u, pickle.dumps(tuple(r))) for u, r in zip(us, pdf[names].astype(object).itertuples(index=False))])
                    first = min(us) if first is None else min(first, *us)
            if first is not None:
                self.handle.registerTimer(-(-first // 1000))
            return iter(())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            """The watermark has passed some of them: these are final, in the order of their times."""
            now = timerValues.getCurrentWatermarkInMs() * 1000
            held = [(u, pickle.loads(bytes(r))) for u, r in (self.waiting.get() if self.waiting.exists() else ())]
            ready = sorted((x for x in held if x[0] <= now), key=lambda x: (x[0], x[1][names.index(order)] if order else 0))
            later = [x for x in held if x[0] > now]
            last = self.last.get()[0] if self.last.exists() else None
            out = []
            for u, row in ready:
                compiled = last is None or u > last + ttl_seconds * 1_000_000
                last = u if compiled else last
                out.append((*row, compiled))
            if later:
                self.waiting.put([(u, pickle.dumps(r)) for u, r in later])
                self.handle.registerTimer(-(-min(u for u, _ in later) // 1000))
            else:
                self.waiting.clear()
            ends = None if last is None else last + ttl_seconds * 1_000_000
            if ends is not None and (ends > now or later):
                self.last.update((last,))
                if not later:
                    self.handle.registerTimer(ends // 1000 + 1)
            else:
                self.last.clear()           # nothing the watermark still lets in can reuse this pack
            if out:
                yield pd.DataFrame(out, columns=[*names, "compiled"])

        def close(self):
            pass

    return Reuse()


def ttl_compiles_stream(requests: DataFrame, key: str = "fingerprint", ttl_seconds: int = 300,
                        watermark: str = "10 minutes", order: str | None = "seq") -> DataFrame:
    """T5 on a stream, by event time: requests that arrive out of order (within the watermark) give what ``ttl_compiles`` gives.

    A request is told ``compiled`` or not once the watermark has passed it. Per-key state is the last compile and the requests that
    still wait; the first goes when the watermark passes its expiry. Needs the RocksDB state store
    (``spark.sql.streaming.stateStore.providerClass``), which keeps appended lists.
    """
    schema = StructType([*requests.schema.fields, StructField("compiled", BooleanType())])
    names = requests.columns
    return (requests.withWatermark("ts", watermark).groupBy(key)
            .transformWithStateInPandas(_ttl_processor(names, ttl_seconds, order), outputStructType=schema, outputMode="Append", timeMode="EventTime"))


def append_request_log(log: DataFrame, sink_dir: str, checkpoint_dir: str, every: str = "1 hour", trigger_once: bool = False):
    """A4 on a stream: each micro-batch appends its partial rollup (``sink_dir/batch=<id>``; a replay overwrites its own).

    No watermark closes a window, so late rows are counted when they come; ``read_request_log`` adds the parts up.
    """
    def run(batch: DataFrame, batch_id: int):
        request_log(batch, every).write.mode("overwrite").parquet(f"{sink_dir}/batch={batch_id:012d}")

    q = log.writeStream.option("checkpointLocation", checkpoint_dir).foreachBatch(run)
    if trigger_once:
        q = q.trigger(availableNow=True)
    return q.start()


def read_request_log(spark, sink_dir: str) -> DataFrame:
    """The rollup that ``append_request_log`` has stored so far."""
    parts = spark.read.schema("window_start timestamp, task_type string, status string, requests long, tokens long, batch string").parquet(sink_dir)
    return parts.groupBy("window_start", "task_type", "status").agg(F.sum("requests").alias("requests"), F.sum("tokens").alias("tokens"))


def request_log(log: DataFrame, every: str = "1 hour") -> DataFrame:
    """A4: rollup of request log rows per time window, task type and status."""
    return (log.groupBy(F.window("ts", every).alias("w"), "task_type", "status")
            .agg(F.count(F.lit(1)).alias("requests"), F.sum("tokens").alias("tokens"))
            .select(F.col("w.start").alias("window_start"), "task_type", "status", "requests", "tokens"))


def log_from_events(events: DataFrame) -> DataFrame:
    """Request log rows from the driver's ``events`` table (one request each)."""
    return events.select(
        "ts", F.lit("POST").alias("method"), F.lit("/v1/chat/completions").alias("route"),
        F.col("event_type").alias("task_type"),
        F.when(F.col("event_type") == "error", "502 ERR").otherwise("200 OK").alias("status"),
        F.round(F.col("value") * 100).cast("long").alias("tokens"))


def enrich_stream(requests: DataFrame, compile_batch, sink_dir: str, checkpoint_dir: str, trigger_once=False):
    """Enrich a request stream micro-batch by micro-batch.

    The budget uses ordinary (non-time) windows, which streams do not allow,
    so ``compile_batch(batch_df) -> DataFrame`` runs on each micro-batch and
    the result is appended to ``sink_dir/batch=<id>`` (a replayed batch
    overwrites its own folder).
    """
    def run(batch: DataFrame, batch_id: int):
        if batch.isEmpty():
            return
        compile_batch(batch).write.mode("overwrite").parquet(f"{sink_dir}/batch={batch_id:012d}")

    q = requests.writeStream.option("checkpointLocation", checkpoint_dir).foreachBatch(run)
    if trigger_once:
        q = q.trigger(availableNow=True)
    return q.start()


def pack_compiler(index, chunks: DataFrame, commit_summary: DataFrame, opts=None, embedder=None, dim: int = 64):
    """T6 + B7: a ``compile_batch`` for ``enrich_stream``.

    Each micro-batch of ``(request_id, repo_id, prompt)`` gets its signals,
    query vectors from the scope hints (U1 hook), and its packs compiled
    against the static index tables.
    """
    from packtables.functions.signals import with_signals
    from packtables.options import PackOptions
    from packtables.plans.index import embed_queries
    from packtables.plans.packs import compile_packs
    from packtables.plans.strategies import StrategyInputs

    opts = opts or PackOptions()

    def compile_batch(batch: DataFrame) -> DataFrame:
        sig = with_signals(batch, word_boundaries=opts.word_boundaries, symbol_stop_words=opts.symbol_stop_words,
                           trim_file_dots=opts.trim_file_dots)
        qv = embed_queries(sig, embedder=embedder, dim=dim)
        return compile_packs(StrategyInputs(sig, index, chunks, qv, commit_summary), opts)

    return compile_batch
