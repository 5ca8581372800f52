"""Jobs over event tables: states, reuse, limits, costs, retention. Batch forms; streaming.limits has the keyed state."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_state(events: DataFrame, keys: list[str], status: str, ts: str, tie: str) -> DataFrame:
    """The last status of each key: a grouped maximum, combined before the shuffle."""
    return events.groupBy(*keys).agg(F.max_by(status, F.struct(ts, tie)).alias("status"), F.max(ts).alias("at"))


def steps_pivot(events: DataFrame, key: str, step: str, steps: list[str]) -> DataFrame:
    return events.groupBy(key).pivot(step, steps).count().na.fill(0, steps)


def reuse_asof(requests: DataFrame, made: DataFrame, hours: int = 24) -> DataFrame:
    """Each request (key, request_id, ts) with the newest result of its key (made_id, made_at) younger than `hours`.

    One window over the union of both, by key and time: no range join, and a key with very many rows costs
    a sort, not a product.
    """
    a = requests.select("key", F.col("ts").alias("t"), F.lit(1).alias("is_request"), F.col("request_id").alias("id"), F.lit(None).cast("timestamp").alias("made_at"), F.lit(None).cast("long").alias("made_id"))
    b = made.select("key", F.col("made_at").alias("t"), F.lit(0).alias("is_request"), F.lit(None).cast("long").alias("id"), "made_at", "made_id")
    upto = Window.partitionBy("key").orderBy("t", "is_request", "made_id").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("is_request") == 0, F.struct("made_at", "made_id")), ignorenulls=True).over(upto)
    found = a.unionByName(b).withColumn("last", last).where("is_request = 1")
    fresh = F.col("t") < F.col("last.made_at") + F.make_dt_interval(hours=F.lit(hours))
    return found.select("key", F.col("id").alias("request_id"), F.when(fresh, F.col("last.made_id")).alias("reused_id"))


def in_flight(requests: DataFrame, runs: DataFrame) -> DataFrame:
    """Each request (key, request_id, ts) with a run of its key (run_id, started, ended) that is going on then; of several, the one that goes on longest.

    Of the runs that began by then the one that ends last is a running maximum in one window over both, and if any goes on, that one does.
    A run without an end still goes on.
    """
    a = requests.select("key", F.col("ts").alias("t"), F.lit(1).alias("is_request"), F.col("request_id").alias("id"), F.lit(None).cast("long").alias("run_id"), F.lit(None).cast("timestamp").alias("ended"))
    b = runs.select("key", F.col("started").alias("t"), F.lit(0).alias("is_request"), F.lit(None).cast("long").alias("id"), "run_id", "ended")
    upto = Window.partitionBy("key").orderBy("t", "is_request", "run_id").rowsBetween(Window.unboundedPreceding, 0)
    last = F.max(F.when(F.col("is_request") == 0, F.struct(F.col("ended").isNull().alias("open"), "ended", "run_id"))).over(upto)
    found = a.unionByName(b).withColumn("last", last).where("is_request = 1")
    return found.select("key", F.col("id").alias("request_id"), F.when(F.col("last.open") | (F.col("t") < F.col("last.ended")), F.col("last.run_id")).alias("run_id"))


def cancelled(watchers: DataFrame, job: str, delta: str, ts: str, tie: str) -> DataFrame:
    """The jobs that nobody waits for any more, and since when: the first time that as many have left (-1) as had come (+1)."""
    upto = Window.partitionBy(job).orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, 0)
    left = watchers.withColumn("__n", F.sum(delta).over(upto)).where(F.col("__n") <= 0)
    return left.groupBy(job).agg(F.min(ts).alias("cancelled_at"))


def daily_limit(hits: DataFrame, limit: int, key: str, ts: str, tie: str) -> DataFrame:
    """allowed and wait_s (to the next UTC midnight) for each hit under a limit a calendar day."""
    day = Window.partitionBy(key, F.to_date(ts)).orderBy(ts, tie)
    n = F.row_number().over(day)
    midnight = F.unix_timestamp(F.date_add(F.to_date(ts), 1).cast("timestamp"))
    return hits.withColumn("allowed", n <= limit).withColumn("wait_s", F.when(n <= limit, F.lit(0).cast("long")).otherwise(midnight - F.unix_timestamp(ts)))


def sliding_limit(hits: DataFrame, limit: int, window_s: float, key: str, ts: str, tie: str, back: str | None = None) -> DataFrame:
    """allowed and wait_s of each hit where only accepted hits count, for `window_s` seconds each.

    back: a boolean column; where it holds, the row is no hit but gives the last accepted one back (allowed is null).

    Acceptance feeds back, so it's a fold in time order over one key's hits; the state is `limit` times. Hits
    arrive in sorted batches, so a key with very many hits is streamed, never held.
    """
    rows = hits.select(F.col(key).cast("string").alias("k"), (F.unix_micros(ts) / 1e6).alias("t"), F.col(tie).cast("long").alias("id"), (F.col(back) if back else F.lit(False)).alias("back"))

    def run(batches):
        current, times = None, []
        for batch in batches:
            allowed, wait = [], []
            for k, t, gives in zip(batch["k"], batch["t"], batch["back"]):
                if k != current:
                    current, times = k, []
                times = [x for x in times if t - x < window_s]
                if gives:
                    times = times[:-1]
                    allowed.append(None)
                    wait.append(0.0)
                    continue
                ok = len(times) < limit
                allowed.append(ok)
                wait.append(0.0 if ok else times[0] + window_s - t)
                if ok:
                    times.append(t)
            yield pd.DataFrame({"k": batch["k"], "id": batch["id"], "allowed": allowed, "wait_s": wait})

    return rows.repartition("k").sortWithinPartitions("k", "t", "id").mapInPandas(run, "k string, id long, allowed boolean, wait_s double")


def usage_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Tokens times the price of their model in dollars for a million; null for a model without a price."""
    return usage.join(prices, "model", "left").withColumn("cost", (F.col("input_tokens") * F.col("input_price") + F.col("output_tokens") * F.col("output_price")) / 1e6)


def first_usable(attempts: DataFrame, total_s: float) -> DataFrame:
    """The first answer that is ok within the running time of all attempts, and the reasons before it."""
    upto = Window.partitionBy("job_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    a = attempts.withColumn("elapsed", F.sum("seconds").over(upto))
    ok = F.col("ok") & (F.col("elapsed") <= total_s)
    return a.groupBy("job_id").agg(F.min_by("answer", F.when(ok, F.col("ord"))).alias("answer"), F.array_sort(F.array_distinct(F.collect_list(F.when(~F.col("ok"), F.col("reason"))))).alias("reasons"))


def most_recent(rows: DataFrame, keep: int, ts: str, tie: str) -> DataFrame:
    """The `keep` rows last used: a top-k, which needs no global sort."""
    return rows.orderBy(F.desc(ts), F.desc(tie)).limit(keep)


def saved_since(rows: DataFrame, ts: str, now: Column, hours: int) -> DataFrame:
    return rows.where(F.col(ts) >= now - F.make_dt_interval(hours=F.lit(hours)))


def numbered(rows: DataFrame, name: str, order: list[str], out: str = "numbered") -> DataFrame:
    """Names made unique: the nth repeat gets "-n"."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(*order))
    return rows.withColumn(out, F.when(n == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("-"), n.cast("string"))))


def client_address(forwarded: Column, hops: int) -> Column:
    """The nth address from the end of X-Forwarded-For, the first one at most."""
    parts = F.transform(F.split(forwarded, ","), lambda p: F.trim(p))
    return F.element_at(parts, -F.least(F.lit(hops), F.size(parts)))
