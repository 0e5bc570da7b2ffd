"""Structured Streaming forms of the polling jobs.

Sources are files landed in a folder; every job runs until it has taken in what is there (``availableNow``) and can be run again
to continue from its checkpoint. Keyed tables lie in buckets (``operators.tables``): inside ``foreachBatch`` a batch rewrites the buckets it
has rows for, and the version notes the batch it came from, so a batch repeated after a failure changes nothing. State is kept on disk by the RocksDB provider.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import geo as G
from ..operators import hotspots as hs
from ..operators import merge, tables
from ..operators.dedup import last_wins
from ..operators.filters import MAX_FEED_ERRORS, window_verdict
from ..operators.links import geocode_fallback
from ..operators.pairs import DAY, tile_join
from ..operators.ranking import last_interactions, saved_since
from ..session import PROVIDER_KEY, ROCKSDB_PROVIDER, scratch_path

#: How late rows may come in joins and densities, by default; later ones are counted, not used.
LATE = "2 days"
#: Failures of a feed that its state lists one by one.
LISTED = 1_000
#: Buckets of a table kept by key; a batch rewrites those that it brings rows for.
BUCKETS = 16


def read_files(spark: SparkSession, folder: str, schema: Any, pattern: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def run_out(writer: Any, spark: SparkSession) -> int:
    """Run a stream until its input is taken in, with state on disk (RocksDB). Returns how many rows its watermarks turned away as too late.

    The state's provider is noted in the checkpoint, so a checkpoint of another provider cannot be gone on with.
    """
    settings = {PROVIDER_KEY: ROCKSDB_PROVIDER, "spark.sql.streaming.numRecentProgressUpdates": "100000"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        # A query takes the settings over as it starts.
        job = writer.trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    job.awaitTermination()
    return sum(int(state.numRowsDroppedByWatermark) for progress in job.recentProgress for state in progress.stateOperators)


def append_to(stream: DataFrame, out: str, checkpoint: str) -> int:
    """Append rows as files, exactly once, until the input is taken in; returns the number of late rows."""
    return run_out(stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append"), stream.sparkSession)


def per_batch(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> int:
    return run_out(stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).outputMode(mode), stream.sparkSession)


def apply_once(root: str, batch_id: int, spark: SparkSession, change: Callable[[DataFrame | None], DataFrame], writer: str = "", bucket: Column | None = None,
               batch: DataFrame | None = None, also: Callable[[list[str]], list[str]] | None = None) -> None:
    """The next version of a table from a batch, unless this batch of this writer is in it already.

    A writer is a checkpoint: batch numbers start again with a new one, and several streams may feed one table in turn (not at once).
    With ``bucket`` only the buckets of the batch's rows are read and rewritten.
    """
    done = (tables.current_version(spark, root) or {}).get("batches", {})
    if done.get(writer, -1) >= batch_id:
        return
    tables.change(spark, root, change, bucket, batch, also, {"batches": {**done, writer: batch_id}})


# ---------------------------------------------------------------- tables kept by key

def upsert_stream(stream: DataFrame, root: str, checkpoint: str, keys: list[str], order: str, buckets: int = BUCKETS) -> None:
    """Events of repeated polls, the last one per key. ``order`` tells which copy is newer, also of copies that come in different batches; of equal ones the later batch counts."""
    def step(batch: DataFrame, batch_id: int) -> None:
        def change(stored: DataFrame | None) -> DataFrame:
            empty = batch.limit(0) if stored is None else stored
            both = empty.withColumn("_later", F.lit(0)).unionByName(batch.withColumn("_later", F.lit(1)))
            return last_wins(both, keys, F.struct(order, "_later")).select(*empty.columns)
        apply_once(root, batch_id, batch.sparkSession, change, checkpoint, tables.by_hash(keys, buckets), batch)
    per_batch(stream, step, checkpoint)


def retention_stream(stream: DataFrame, root: str, checkpoint: str, as_of: Column, cutoff: Column, window: str) -> None:
    """Appends each poll, archives what is old and removes what was archived long ago. Days after the cutoff that a poll brings nothing for stay as they are."""
    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        last = spark.range(1).select(F.date_format(cutoff, "yyyy-MM-dd")).first()[0]
        apply_once(root, batch_id, spark, lambda stored: merge.retention(batch if stored is None else stored.unionByName(batch), as_of, cutoff, window), checkpoint,
                   tables.by_day(F.col("occurred_at")), batch, lambda days: [d for d in days if d <= last])
    per_batch(stream, step, checkpoint)


# ---------------------------------------------------------------- items

def unique_items(stream: DataFrame, keys: list[str], out: str, checkpoint: str, forget: str | None = None) -> None:
    """Items never seen before. With ``forget``, ids are dropped from the state that long after their ``ts``, and may then come again."""
    known = stream.dropDuplicates(keys) if forget is None else stream.withWatermark("ts", forget).dropDuplicatesWithinWatermark(keys)
    append_to(known.select(*keys), out, checkpoint)


def timely_items(stream: DataFrame, out: str, checkpoint: str, as_of: Column, hours: int) -> None:
    append_to(stream.filter(window_verdict(F.col("ts"), as_of, hours)), out, checkpoint)


def window_tally(stream: DataFrame, root: str, checkpoint: str, as_of: Column, hours: int) -> None:
    """Counts of kept, late and future items."""
    ts = F.col("ts")
    verdict = F.when(window_verdict(ts, as_of, hours), F.lit("kept")).when(ts > as_of, F.lit("future")).otherwise(F.lit("late"))
    counts = stream.groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))
    # Complete mode: each batch brings the whole (three-row) table.
    per_batch(counts, lambda batch, batch_id: apply_once(root, batch_id, batch.sparkSession, lambda _: batch, checkpoint), checkpoint, "complete")


# ---------------------------------------------------------------- densities and clusters

def cell_density_stream(stream: DataFrame, out: str, checkpoint: str, step: float = 1.0, bucket: str = "1 day", slide: str | None = None, late: str = LATE) -> int:
    """Weight and count per cell and time bucket, written when the bucket can no longer change. Returns the number of rows that came too late."""
    cells = stream.withColumn("cell_lat", G.grid_cell(F.col("lat"), step)).withColumn("cell_lng", G.grid_cell(F.col("lng"), step))
    grouped = cells.withWatermark("ts", late).groupBy(F.window("ts", bucket, slide), "cell_lat", "cell_lng").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n"))
    return append_to(grouped.select(F.col("window.start").alias("start"), "cell_lat", "cell_lng", "weight", "n"), out, checkpoint)


def hotspot_stream(stream: DataFrame, root: str, checkpoint: str) -> None:
    """Running cluster figures per cell and day; clusters are those that reach the threshold.

    Each batch is aggregated first; its partial figures are then combined with the stored ones of the same days.
    """
    keys = ["cell_lat", "cell_lng", "acq_date"]

    def step(batch: DataFrame, batch_id: int) -> None:
        frp = F.coalesce(F.col("frp"), F.lit(0.0))
        fresh = hs.with_cell(batch).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max(frp).alias("max_frp"), F.sum(frp).alias("sum_frp"), F.max("acq_at").alias("last_at"))

        def change(stored: DataFrame | None) -> DataFrame:
            both = fresh if stored is None else stored.unionByName(fresh)
            return both.groupBy(*keys).agg(F.sum("n").alias("n"), F.max("max_frp").alias("max_frp"), F.sum("sum_frp").alias("sum_frp"), F.max("last_at").alias("last_at"))

        apply_once(root, batch_id, batch.sparkSession, change, checkpoint, tables.by_day(F.col("acq_date")), fresh)
    per_batch(stream, step, checkpoint)


def clusters_of(figures: DataFrame) -> DataFrame:
    kept = figures.filter((F.col("n") >= hs.MIN_COUNT) | (F.col("max_frp") >= hs.MIN_FRP))
    return kept.select("cell_lat", "cell_lng", "acq_date", F.col("n").alias("hotspot_count"), "max_frp", (F.col("sum_frp") / F.col("n")).alias("mean_frp"), F.col("last_at").alias("occurred_at"))


# ---------------------------------------------------------------- profiles

def profile_stream(stream: DataFrame, root: str, checkpoint: str, buckets: int = BUCKETS) -> None:
    """Profiles from action logs: saved items, current opinions and the last interactions, one table of rows that still matter.

    Stored rows are actions again, so a batch is simply added and the same rules are applied: later actions win, and a saved item keeps
    the time of its first save.
    """
    columns = ["user_id", "event_id", "kind", "view", "acted_at", "seq"]

    def compact(actions: DataFrame) -> DataFrame:
        saves = saved_since(actions).withColumnRenamed("added_at", "acted_at").join(
            actions.filter("kind = 'save'").select("user_id", "event_id", "acted_at", "seq"), ["user_id", "event_id", "acted_at"]).groupBy("user_id", "event_id", "acted_at", "view").agg(F.min("seq").alias("seq"))
        opinions = actions.filter(F.col("kind").isin("more", "less", "clear")).groupBy("user_id", "event_id").agg(F.max_by(F.struct("kind", "view", "acted_at", "seq"), "seq").alias("o")).select("user_id", "event_id", "o.*").filter("kind <> 'clear'")
        recent = last_interactions(actions.filter(F.col("kind").isin("open", "source")), "user_id", [F.desc("acted_at"), F.desc("seq")])
        return saves.withColumn("kind", F.lit("save")).select(*columns).unionByName(opinions.select(*columns)).unionByName(recent.select(*columns))

    def step(batch: DataFrame, batch_id: int) -> None:
        new = batch.select(*columns)
        apply_once(root, batch_id, batch.sparkSession, lambda stored: compact(new if stored is None else stored.unionByName(new)), checkpoint, tables.by_hash(["user_id"], buckets), new)
    per_batch(stream, step, checkpoint)


def profile_summary(profile: DataFrame) -> DataFrame:
    """Counts per user of a compacted profile."""
    kinds = {"saved": ["save"], "liked": ["more"], "disliked": ["less"], "interactions": ["open", "source"]}
    return profile.groupBy("user_id").agg(*[F.count_if(F.col("kind").isin(k)).alias(name) for name, k in kinds.items()])


# ---------------------------------------------------------------- feed health

def feed_health_stream(polls: DataFrame, out: str, checkpoint: str, listed: int = LISTED) -> None:
    """Consecutive failures per feed. Input: feed_url, seq, ok. Every batch appends the new state of the feeds it touched.

    The state is the last success, the newest ``listed`` failures after it, and the number of those before them, so it stays small for a feed that never succeeds. Polls may come in any order. A success that
    comes so late that failures before and after it are no longer listed is not used, and counted in ``late``.
    """
    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last_ok, last, folded, folded_to, late, known = state.get if state.exists else (-1, -1, 0, -1, 0, [])
        failed = np.asarray(known, dtype=np.int64)
        for rows in batches:
            ok = rows["ok"].to_numpy(dtype=bool)
            seq = rows["seq"].to_numpy(dtype=np.int64)
            good, bad = seq[ok], seq[~ok]
            late += int(((good > last_ok) & (good <= folded_to)).sum())
            usable = good[(good > folded_to) | (folded_to < 0)]
            if len(usable) and usable.max() > last_ok:
                last_ok, folded, folded_to = int(usable.max()), 0, -1
            # Only failures after the last success count.
            bad = bad[bad > last_ok]
            folded += int((bad <= folded_to).sum())
            failed = np.sort(np.concatenate([failed, bad[bad > folded_to]]))
            failed = failed[failed > last_ok]
            if len(failed) > listed:
                folded, folded_to, failed = folded + len(failed) - listed, int(failed[-listed - 1]), failed[-listed:]
            last = max(last, int(seq.max()))
        errors = folded + len(failed)
        state.update((int(last_ok), int(last), int(folded), int(folded_to), int(late), [int(x) for x in failed]))
        yield pd.DataFrame({"feed_url": [key[0]], "error_count": [int(errors)], "last_seq": [int(last)], "paused": [bool(errors >= MAX_FEED_ERRORS)], "late": [int(late)]})

    states = polls.groupBy("feed_url").applyInPandasWithState(
        update, "feed_url string, error_count bigint, last_seq bigint, paused boolean, late bigint", "last_ok bigint, last bigint, folded bigint, folded_to bigint, late bigint, failed array<bigint>", "update", GroupStateTimeout.NoTimeout)

    def step(batch: DataFrame, batch_id: int) -> None:
        # A batch has its own folder, so a repeated batch replaces itself.
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    per_batch(states, step, checkpoint, "update")


def latest_health(spark: SparkSession, out: str) -> DataFrame:
    rows = spark.read.parquet(out)
    # The last batch that touched a feed holds its state.
    return rows.groupBy("feed_url").agg(F.max_by(F.struct("error_count", "paused"), "batch").alias("s")).select("feed_url", "s.*")


# ---------------------------------------------------------------- joins

def enrich_stream(items: DataFrame, publishers: DataFrame, gazetteer: DataFrame, centroids: DataFrame, out: str, checkpoint: str) -> None:
    """Items with their publisher's name and coordinates: joins of a stream with static tables."""
    named = items.join(publishers.select("publisher_id", "name"), "publisher_id", "left")
    append_to(geocode_fallback(named, gazetteer, centroids), out, checkpoint)


def news_disaster_stream(news: DataFrame, disasters: DataFrame, out: str, checkpoint: str, km: float, days: int, late: str = LATE, listed: bool = True) -> int:
    """News up to ``days`` after a disaster within ``km``. Returns the number of rows that came too late.

    Pairs grow with the square of the rows. If they are not ``listed``, a batch writes the rows that came in time instead of its pairs, and ``news_disaster_links`` reads the pairs from those.

    A batch's rows meet each other and the open rows of earlier batches in tiles (``tile_join``), not row by row in a state store. Rows are late if they are not newer than ``late`` before
    the newest row of the side that is behind, as earlier batches left it; what no timely row can meet any more is dropped from the open rows. Batch k reads those that batch k - 1 left, and
    replaces its own pairs and open rows, so a repeated batch changes nothing.
    """
    marked = lambda df, is_news: df.select("id", "lat", "lng", "ts", F.lit(is_news).alias("is_news"))
    too_late: list[int] = []

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # Two folders in turn: the one a batch reads is not the one it writes.
        kept = lambda k: f"{out}-open/{k % 2}"
        rows = batch.select("id", "lat", "lng", F.unix_micros("ts").alias("t_us"), "is_news").persist()
        try:
            known = spark.read.schema(rows.schema).parquet(kept(batch_id - 1)) if batch_id else rows.limit(0)
            mark = closed_before(known, late) if batch_id else None
            fresh = rows
            if mark is not None:
                too_late.append(rows.filter(F.col("t_us") <= mark).count())
                fresh = rows.filter(F.col("t_us") > mark)
            side = lambda df, is_news: df.filter(F.col("is_news") == is_news).drop("is_news")
            lag = days * DAY
            if listed:
                pairs = tile_join(side(fresh, True), side(fresh.unionByName(known), False) if batch_id else side(fresh, False), km, lag)
                if batch_id:
                    pairs = pairs.unionByName(tile_join(side(known, True), side(fresh, False), km, lag))
                pairs.select(F.col("id_a").alias("news_id"), F.col("id_b").alias("disaster_id"), "km").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
            else:
                fresh.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
            everything = fresh.unionByName(known).filter(F.col("t_us").isNotNull())
            mark = closed_before(everything, late)
            if mark is not None:
                everything = everything.filter(F.col("t_us") > F.when(F.col("is_news"), F.lit(mark)).otherwise(F.lit(mark - lag - 1)))
            everything.write.mode("overwrite").parquet(kept(batch_id))
        finally:
            rows.unpersist()

    per_batch(marked(news, True).unionByName(marked(disasters, False)), step, checkpoint)
    return sum(too_late)


def news_disaster_links(spark: SparkSession, out: str, km: float, days: int) -> DataFrame:
    """(news_id, disaster_id, km): the pairs of ``news_disaster_stream`` where it does not list them.

    All rows in time meet all others, whatever their batches: a batch drops from the open rows only what no row in time can meet any more.
    """
    side = lambda is_news: spark.read.parquet(out).filter(F.col("is_news") == is_news).select("id", "lat", "lng", "t_us")
    return tile_join(side(True), side(False), km, days * DAY).select(F.col("id_a").alias("news_id"), F.col("id_b").alias("disaster_id"), "km")


def closed_before(rows: DataFrame, late: str) -> int | None:
    """The time, in microseconds, that later rows must exceed: ``late`` before the newest row of the side that is behind; none as long as a side has no rows."""
    newest = F.least(F.max(F.when(F.col("is_news"), F.col("t_us"))), F.max(F.when(~F.col("is_news"), F.col("t_us"))))
    both = F.count_if("is_news") * F.count_if(~F.col("is_news")) > 0
    return rows.agg(F.when(both, F.unix_micros(F.timestamp_micros(newest) - F.expr(f"INTERVAL {late}"))).alias("mark")).first()["mark"]


def places_for(spark: SparkSession, name: str) -> tuple[str, str]:
    """A new (output, checkpoint) pair below the shared folder."""
    root = scratch_path(spark, name)
    return f"{root}/out", f"{root}/checkpoint"
