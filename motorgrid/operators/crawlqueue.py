"""The crawl queue as snapshots: every transition returns the full new table.

Parquet has no UPDATE; callers write the result to a new path. One job at a time owns the queue.
Times are arguments, never the clock.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motorgrid import constants as K
from motorgrid import schemas
from motorgrid.functions.calc import backoff_seconds, plus_seconds
from motorgrid.operators.lookups import first_per_key, insert_new, merge_join
from motorgrid.operators.skew import cut_by_ranges, running_total


def new_items(rows: DataFrame, now: Column) -> DataFrame:
    """Give URL rows the queue's columns: pending, no attempts, due now."""
    present = set(rows.columns)
    fixed = {
        "status": F.lit("pending"), "attempts": F.lit(0), "last_error": F.lit(None),
        "next_try_at": now, "enqueued_at": now, "claimed_at": F.lit(None),
    }
    return rows.select(*[
        (fixed[f.name] if f.name in fixed
         else F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schemas.CRAWL_QUEUE.fields])


def enqueue(queue: DataFrame, rows: DataFrame, now: Column, order: Iterable = ("url",)) -> DataFrame:
    """Queue plus the rows whose URL is new (the first of each URL in ``order``)."""
    fresh = insert_new(queue, rows, "url", order)
    return queue.unionByName(new_items(fresh, now))


def claim_order() -> list[Column]:
    kind = (
        F.when(F.col("kind") == "image", 0).when(F.col("kind") == "listing", 1)
        .when(F.col("kind") == "search", 2).otherwise(3)
    )
    return [kind, F.col("next_try_at"), F.col("enqueued_at"), F.col("url")]


def due_items(queue: DataFrame, now: Column, source: str | None = None) -> DataFrame:
    due = queue.where((F.col("status") == "pending") & (F.col("next_try_at") <= now))
    return due if source is None else due.where(F.col("source") == source)


def next_batch(queue: DataFrame, n: int, now: Column, source: str | None = None) -> DataFrame:
    """Up to n due items: images, then listings, then searches; oldest first."""
    return due_items(queue, now, source).orderBy(*claim_order()).limit(n)


def budgeted_batch(queue: DataFrame, budgets: DataFrame, now: Column) -> DataFrame:
    """Due items up to each source's own limit; ``budgets`` is (source, max_items).

    The largest budget is a plain number, so tasks drop everything beyond it before the shuffle.
    """
    ceiling = budgets.agg(F.max("max_items")).first()[0] or 0
    order = Window.partitionBy("source").orderBy(*claim_order())
    ranked = due_items(queue, now).withColumn("_rn", F.row_number().over(order)).where(
        F.col("_rn") <= ceiling)
    return ranked.join(budgets, "source").where("_rn <= max_items").drop("_rn", "max_items")


def mark_claimed(queue: DataFrame, batch: DataFrame, now: Column) -> DataFrame:
    taken = batch.select("url", F.lit(True).alias("_taken"))
    return merge_join(queue, taken, "url", "left").withColumn(
        "status", F.when(F.col("_taken"), "in_progress").otherwise(F.col("status"))).withColumn(
        "claimed_at", F.when(F.col("_taken"), now).otherwise(F.col("claimed_at"))
    ).select(*queue.columns)


def claim_batch(queue: DataFrame, n: int, now: Column, source: str | None = None) -> DataFrame:
    """Queue with the next batch in progress."""
    return mark_claimed(queue, next_batch(queue, n, now, source), now)


# Effects of one outcome on a row; ``a`` is the number of attempts after it.
def _applied(queue: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    attempts = F.when(F.col("_action") == "failed", F.col("attempts") + 1).when(
        F.col("_action") == "requeue", 0).otherwise(F.col("attempts"))
    effects = outcomes.select("url", F.col("action").alias("_action"), F.col("error").alias("_error"))
    staged = merge_join(queue, effects, "url", "left").withColumn("_a", attempts)
    action = F.col("_action")
    changes = {
        "attempts": F.col("_a").cast("int"),
        "status": F.when(action == "done", "done")
        .when(action == "failed", F.when(
            F.col("_a") >= K.DEAD_AFTER_ATTEMPTS, "dead").otherwise("failed"))
        .when(action == "dead", "dead").when(action == "requeue", "pending")
        .otherwise(F.col("status")),
        "last_error": F.when(action.isin("done", "requeue"), None)
        .when(action == "failed", F.col("_error"))
        .when(action == "dead", F.coalesce("_error", "last_error")).otherwise(F.col("last_error")),
        "next_try_at": F.when(action == "failed", plus_seconds(now, backoff_seconds(F.col("_a"))))
        .when(action == "requeue", now).otherwise(F.col("next_try_at")),
        "claimed_at": F.when(action == "requeue", None).otherwise(F.col("claimed_at")),
    }
    return staged.select(*[changes.get(c, F.col(c)).alias(c) for c in queue.columns])


def apply_outcomes(queue: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """At most one outcome per URL: (url, action, error). Unknown URLs have no effect."""
    return _applied(queue, outcomes, now)


def mark_done(queue: DataFrame, urls: DataFrame, now: Column) -> DataFrame:
    return _applied(queue, urls.select("url", F.lit("done").alias("action"),
                                       F.lit(None).cast("string").alias("error")), now)


def mark_failed(queue: DataFrame, errors: DataFrame, now: Column) -> DataFrame:
    """(url, error): one more attempt, back-off, dead at five. Failed rows wait for a requeue."""
    return _applied(queue, errors.select("url", F.lit("failed").alias("action"), "error"), now)


def mark_dead(queue: DataFrame, errors: DataFrame, now: Column) -> DataFrame:
    return _applied(queue, errors.select("url", F.lit("dead").alias("action"), "error"), now)


def requeue(queue: DataFrame, urls: DataFrame, now: Column) -> DataFrame:
    return _applied(queue, urls.select("url", F.lit("requeue").alias("action"),
                                       F.lit(None).cast("string").alias("error")), now)


def fold_events(queue: DataFrame, events: DataFrame) -> DataFrame:
    """Apply a history of events to the queue, whatever its length per URL.

    ``events``: url, source, kind, action (enqueue, done, failed, dead, requeue), error, ts, seq.
    A URL starts to exist at its first enqueue, earlier events do not count, later enqueues do
    nothing. Instead of replaying a URL's events in one task, the state is taken from the last
    event of each sort and the number of failures after the last requeue; that number is the
    difference of two running counts, which a prefix scan over sampled ranges gives: a URL may have
    any number of events, at one time too. seq tells events of one ts apart.
    """
    known = queue.select("url", F.lit(True).alias("_known"))
    ranged = cut_by_ranges(events.select(
        "url", "source", "kind", "action", "error", "ts", "seq"), ["url"], ["ts", "seq"])
    counted = running_total(
        ranged, ["url"], ["ts", "seq"], F.col("_piece"), (F.col("action") == "failed").cast("int"),
        "_fails_before").drop("_cell", "_bucket")
    at = F.struct("ts", "seq")

    def when(*actions: str) -> Column:
        return F.when(F.col("action").isin(*actions), at)

    # Combined inside every task: one row per URL and task reaches the shuffle.
    born_at = when("enqueue")
    lasts = counted.groupBy("url").agg(
        F.min(born_at).alias("_born"),
        F.min_by(F.struct("source", "kind", "_fails_before"), born_at).alias("_birth"),
        F.max(when("done", "failed", "dead", "requeue")).alias("_last_at"),
        F.max_by("action", when("done", "failed", "dead", "requeue")).alias("_last"),
        F.max(when("requeue")).alias("_reset_at"),
        F.max_by("_fails_before", when("requeue")).alias("_reset_fails"),
        F.max(when("failed")).alias("_fail_at"),
        F.count_if(F.col("action") == "failed").alias("_fails"),
        F.max(F.when(F.col("action").isin("done", "failed", "requeue")
                     | ((F.col("action") == "dead") & F.col("error").isNotNull()), at))
        .alias("_error_at"),
        F.max_by(
            F.struct(F.when(F.col("action").isin("failed", "dead"), F.col("error")).alias("e")),
            F.when(F.col("action").isin("done", "failed", "requeue")
                   | ((F.col("action") == "dead") & F.col("error").isNotNull()), at))
        .alias("_error"),
    )
    state = queue.join(
        merge_join(lasts, known, "url", "left")
        .where("_known or _born is not null").drop("_known"), "url", "full_outer")
    fresh = F.col("status").isNull()
    # Events of a new URL count from its birth on.
    born = F.when(fresh, F.col("_born"))

    def valid(moment: str) -> Column:
        return F.col(moment).isNotNull() & (born.isNull() | (F.col(moment) > born))

    reset = valid("_reset_at")
    base_fails = F.when(reset, F.col("_reset_fails")).when(
        fresh, F.col("_birth._fails_before")).otherwise(0)
    new_fails = F.coalesce(F.col("_fails") - base_fails, F.lit(0))
    attempts = (F.when(reset | fresh, 0).otherwise(F.col("attempts")) + new_fails).cast("int")
    last = F.when(valid("_last_at"), F.col("_last"))
    born_ts = F.col("_born.ts")
    failed_after_reset = valid("_fail_at") & (~reset | (F.col("_fail_at") > F.col("_reset_at")))
    changes = {
        "source": F.when(fresh, F.col("_birth.source")).otherwise(F.col("source")),
        "kind": F.when(fresh, F.col("_birth.kind")).otherwise(F.col("kind")),
        "attempts": attempts,
        "status": F.when(last == "done", "done").when(last == "dead", "dead")
        .when(last == "requeue", "pending")
        .when(last == "failed", F.when(
            attempts >= K.DEAD_AFTER_ATTEMPTS, "dead").otherwise("failed"))
        .otherwise(F.coalesce("status", F.lit("pending"))),
        "last_error": F.when(valid("_error_at"), F.col("_error.e")).otherwise(F.col("last_error")),
        "next_try_at": F.when(
            failed_after_reset, plus_seconds(F.col("_fail_at.ts"), backoff_seconds(attempts)))
        .when(reset, F.col("_reset_at.ts")).when(fresh, born_ts)
        .otherwise(F.col("next_try_at")),
        "enqueued_at": F.when(fresh, born_ts).otherwise(F.col("enqueued_at")),
        "claimed_at": F.when(reset, None).otherwise(F.col("claimed_at")),
    }
    return state.select(*[changes.get(c, F.col(c)).alias(c) for c in queue.columns])


def seed_stats(queue: DataFrame, seeds: DataFrame) -> DataFrame:
    """Yielded, inserted and duplicate seeds per source, and in total (null source)."""
    per_url = seeds.groupBy("source", "url").agg(F.count("*").alias("_n"))
    # A URL is inserted once, for whichever source comes first by name.
    first = first_per_key(per_url.select("url", "source"), ["url"], ["source"]).withColumn(
        "_first", F.lit(1))
    old = queue.select("url", F.lit(1).alias("_old"))
    joined = per_url.join(first, ["url", "source"], "left").join(old, "url", "left")
    inserted = F.count_if(F.col("_first").isNotNull() & F.col("_old").isNull())
    return joined.rollup("source").agg(
        F.sum("_n").alias("yielded"), inserted.alias("inserted"),
        (F.sum("_n") - inserted).alias("duplicates"))


def sitemap_stats(links: DataFrame, queue: DataFrame, source: str, is_listing: Column,
                  max_listings: int | None = None, n_examples: int = 5) -> DataFrame:
    """Walked, matched, inserted and duplicate URLs of one sitemap, and its first matches.

    ``links`` has url and position, the order of the walk. With ``max_listings`` the walk ends at
    the link that reaches that number.
    """
    matched = links.where(is_listing)
    first = matched.orderBy("position", "url").limit(n_examples).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("position", "url"))), lambda x: x["url"])
        .alias("examples"))
    walked = links
    if max_listings is not None:
        matched = matched.orderBy("position", "url").limit(max_listings)
        end = matched.agg(F.when(F.count("*") >= max_listings, F.max("position")).alias("end"))
        last = end.scalar()
        walked = links.where(last.isNull() | (F.col("position") <= last))
    found = matched.groupBy("url").agg(F.count("*").alias("_n")).join(
        queue.select("url", F.lit(1).alias("_old")), "url", "left")
    inserted = F.count_if(F.col("_old").isNull())
    return found.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("matched"), inserted.alias("inserted"),
    ).select(
        F.lit(source).alias("source"), walked.agg(F.count("*")).scalar().alias("walked"),
        "matched", "inserted", (F.col("matched") - F.col("inserted")).alias("duplicates"),
        first.scalar().alias("examples"))


def source_report(queue: DataFrame, listings: DataFrame, n_examples: int = 3) -> DataFrame:
    """Per source: URLs by kind and status, listing rows and the first failed examples."""
    def n(condition: Column, name: str) -> Column:
        return F.count_if(condition).alias(name)

    kind, status = F.col("kind"), F.col("status")
    counts = queue.groupBy("source").agg(
        n(kind == "listing", "listing_urls"),
        n((kind == "listing") & (status == "done"), "listing_done"),
        n(kind == "image", "image_urls"),
        *[n((kind == "search") & (status == s), f"search_{s}") for s in K.QUEUE_STATUSES],
        n((kind == "search") & F.col("last_error").isNotNull(), "search_errors"))
    rows = listings.groupBy("source").agg(F.count("*").alias("_rows"))
    order = Window.partitionBy("source").orderBy("enqueued_at", "url")
    examples = queue.where(status.isin("failed", "dead")).withColumn(
        "_rn", F.row_number().over(order)).where(F.col("_rn") <= n_examples).groupBy("source").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_rn", "url"))), lambda x: x["url"])
        .alias("_ex"))
    empty = F.array().cast("array<string>")
    return counts.join(rows, "source", "left").join(examples, "source", "left").select(
        *counts.columns, F.coalesce("_rows", F.lit(0)).alias("listing_rows"),
        F.coalesce("_ex", empty).alias("failed_examples"))
