"""Worklists: what was asked, what is there, what is still missing, who works on it."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfmerge.functions.ids import is_isbn, normalize_isbn, search_url
from shelfmerge.functions.text import is_blank


def dedupe_keep_first(df: DataFrame, key: list[str], *order: str) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def isbn_lines(lines: DataFrame, limit: int | None = None) -> DataFrame:
    """(line_no, raw) to (line_no, isbn): remarks dropped, the limit taken before repeats go, first ones kept."""
    raw = F.trim(F.col("raw"))
    field = F.trim(F.split(raw, r"[\t;|,]", 2)[0])
    token = F.when(is_isbn(field), field).otherwise(F.split(raw, r"\s+")[0])
    rows = lines.filter((raw != "") & ~raw.startswith("#")).select("line_no", token.alias("t"))
    rows = rows.filter(is_isbn(F.col("t"))).select("line_no", normalize_isbn(F.col("t")).alias("isbn"))
    if limit:
        rows = rows.orderBy("line_no").limit(limit)
    return dedupe_keep_first(rows, ["isbn"], "line_no")


def parse_query_items(lines: DataFrame, mode: str = "pair") -> DataFrame:
    """(line_no, raw) to (line_no, raw, isbn, title, url).

    pair: ``ISBN | TITLE`` or with a tab; eight digits or more make a number, also in
    a title. url: as pair, and lines with an address give it. isbn: the number only,
    first of repeats. first: the field before a tab, semicolon, bar or comma.
    """
    raw = F.trim(F.col("raw"))
    rows = lines.filter((raw != "") & ~raw.startswith("#") & ~raw.rlike(r"^\d{1,3}$")).withColumn("raw", raw)
    if mode == "first":
        return rows.select("line_no", "raw", F.trim(F.split("raw", r"[\t;|,]", 2)[0]).alias("query"))
    digits = lambda c: F.regexp_replace(c, "[^0-9Xx]", "")
    if mode == "isbn":
        found = rows.select("line_no", normalize_isbn(F.regexp_extract("raw", r"[0-9Xx-]{10,}", 0)).alias("isbn"))
        return dedupe_keep_first(found.filter(is_isbn(F.col("isbn"))), ["isbn"], "line_no")
    cut = F.when(F.col("raw").contains("|"), F.instr("raw", "|")).otherwise(F.instr("raw", "\t"))
    sides = rows.withColumn("_cut", cut).withColumns(
        {
            "_l": F.expr("CASE WHEN _cut > 0 THEN trim(substr(raw, 1, _cut - 1)) ELSE raw END"),
            "_r": F.expr("CASE WHEN _cut > 0 THEN trim(substr(raw, _cut + 1)) END"),
        }
    )
    sides = sides.withColumns({"_ld": digits(F.col("_l")), "_rd": digits(F.col("_r"))})
    long_left, long_right = F.length("_ld") >= 8, F.length("_rd") >= 8
    isbn = F.when(long_left, F.col("_ld")).when(long_right, F.col("_rd"))
    title = F.when(F.col("_cut") == 0, F.when(~long_left, F.col("raw"))).when(
        (F.col("_r") != "") & (long_left | ~long_right), F.col("_r")
    )
    url = F.regexp_extract("raw", r"https?://[^\s|]+", 0)
    out = sides.select(
        "line_no",
        "raw",
        isbn.alias("isbn"),
        title.alias("title"),
        (F.nullif(url, F.lit("")) if mode == "url" else F.lit(None).cast("string")).alias("url"),
    )
    return out.filter(F.col("isbn").isNotNull() | F.col("title").isNotNull())


def queue_rows(df: DataFrame, from_text: bool = False) -> DataFrame:
    """Queue rows with their number cleaned and a search address; the text form drops repeats."""
    isbn = normalize_isbn(F.col("isbn"))
    trimmed = {c: F.trim(F.coalesce(F.col(c), F.lit(""))) for c in ("site", "url", "titulo", "amazon_search_url")}
    rows = df.select(
        "pos",
        isbn.alias("isbn"),
        *[v.alias(c) for c, v in trimmed.items() if c != "amazon_search_url"],
        F.coalesce(F.nullif(trimmed["amazon_search_url"], F.lit("")), search_url(isbn)).alias("amazon_search_url"),
    ).filter("isbn <> ''")
    return dedupe_keep_first(rows, ["isbn"], "pos") if from_text else rows


def isbns_present(std: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted numbers that the table has, each once."""
    have = std.filter(~is_blank(F.col("isbn"))).select("isbn")
    return wanted.select("isbn").distinct().join(have, "isbn", "left_semi")


def missing_queries(queries: DataFrame, found: DataFrame) -> DataFrame:
    """Lines whose number was not found; lines that hold none always stay."""
    key = normalize_isbn(F.split("raw", r"[\t|;,]", 2)[0])
    q = queries.withColumn("_k", F.when(F.length(key).isin(10, 13), key))
    have = found.select(normalize_isbn(F.col("isbn")).alias("_k")).filter("_k <> ''").distinct()
    return q.join(have, "_k", "left_anti").drop("_k")


def accumulate_remaining(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both lists' numbers of 10 or 13 digits, distinct and sorted; a final X is lost as a digit."""
    digits = F.regexp_replace("raw", "[^0-9]", "").alias("isbn")
    both = old.select(digits).union(new.select(digits))
    return both.filter(F.length("isbn").isin(10, 13)).distinct().orderBy("isbn")


def combine_sources(*dfs: DataFrame) -> DataFrame:
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def state_of_queue(state: DataFrame, queue: DataFrame) -> DataFrame:
    return state.join(queue.select("isbn"), "isbn", "left_semi")


def unseen(urls: DataFrame, seen: DataFrame) -> DataFrame:
    return urls.join(seen.select("url"), "url", "left_anti")


def cascade(queries: DataFrame, sources: DataFrame, single: bool = False) -> DataFrame:
    """Rows of each query's first source that has it. sources: (isbn, source_rank, seq, ...).

    One pass: the lowest rank per number, instead of a search by search loop.
    single keeps one row of it.
    """
    hits = sources.join(queries.select("isbn").distinct(), "isbn", "left_semi")
    w = Window.partitionBy("isbn")
    first = hits.withColumn("_best", F.min("source_rank").over(w)).filter("source_rank = _best").drop("_best")
    return dedupe_keep_first(first, ["isbn"], "seq") if single else first


def cascade_stages(queries: DataFrame, sources: DataFrame, ranks: list[int]) -> DataFrame:
    """(source_rank, submitted, found, remaining) of every stage."""
    asked = queries.select("isbn").distinct()
    best = sources.groupBy("isbn").agg(F.min("source_rank").alias("best"))
    placed = asked.join(best, "isbn", "left")
    reached = lambda r: F.count_if(F.col("best").isNull() | (F.col("best") >= r))
    rows = [
        placed.agg(
            F.lit(r).alias("source_rank"),
            reached(r).alias("submitted"),
            F.count_if(F.col("best") == r).alias("found"),
            reached(r + 1).alias("remaining"),
        )
        for r in ranks
    ]
    return combine_sources(*rows)


def coverage(queries: DataFrame, found: DataFrame, by: str = "chunk") -> DataFrame:
    """Submitted, found, missing and rate per chunk."""
    have = found.select("isbn").distinct().withColumn("_f", F.lit(1))
    rows = queries.join(have, "isbn", "left").groupBy(by).agg(F.count("*").alias("submitted"), F.count("_f").alias("found"))
    return rows.select(
        by, "submitted", "found", (F.col("submitted") - F.col("found")).alias("missing"),
        F.round(F.col("found") / F.col("submitted"), 4).alias("rate"),
    )


#: Numbers in a block of with_position.
BLOCK = 1 << 16


def with_position(df: DataFrame, order: str, name: str = "position") -> DataFrame:
    """df with the place of each row, from 0, by a whole number that no two rows share.

    Rows are numbered within blocks of numbers; the blocks' counts are summed up. The
    numbers may have gaps, but should lie in dense stretches, as line numbers do: the
    sums are over one row a block.
    """
    block = F.floor(F.col(order) / BLOCK).alias("_block")
    counts = df.groupBy(block).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_block", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_block").orderBy(order))
    placed = df.withColumn("_block", block).join(offsets, "_block")
    return placed.withColumn(name, (F.col("_before") + within - 1).cast("bigint")).drop("_block", "_before")


def chunk_worklist(df: DataFrame, n: int = 50, order: str = "line_no") -> DataFrame:
    """df with chunk, from 1: n rows each, the last perhaps fewer, by their place and not by the number itself."""
    placed = with_position(df, order, "_place")
    return placed.withColumn("chunk", F.floor(F.col("_place") / max(1, n)).cast("bigint") + 1).drop("_place")


def crawl_stats(pages: DataFrame) -> DataFrame:
    """Pages by what became of them."""
    return pages.groupBy("outcome").agg(F.count("*").alias("n"))


def dead_letters(df: DataFrame) -> DataFrame:
    return df.filter(F.col("reason").isNotNull()).select("url", "reason")


def queue_status(queue: DataFrame, state: DataFrame) -> DataFrame:
    """The queue with each row's state; done comes before skipped before in_progress, the rest is open."""
    rank = F.min(F.when(F.col("status") == "done", 1).when(F.col("status") == "skipped", 2).otherwise(3)).alias("_s")
    s = state.groupBy("isbn").agg(rank)
    status = F.when(F.col("_s") == 1, "done").when(F.col("_s") == 2, "skipped").when(F.col("_s") == 3, "in_progress")
    return queue.join(s, "isbn", "left").withColumn("status", F.coalesce(status, F.lit("open"))).drop("_s")


def queue_stats(status: DataFrame) -> DataFrame:
    """total counts rows, the others distinct numbers."""
    of = lambda s: F.count_distinct(F.when(F.col("status") == s, F.col("isbn"))).alias(s)
    rows = status.agg(F.count("*").alias("total"), of("done"), of("skipped"), of("in_progress"))
    left = F.col("total") - F.col("done") - F.col("skipped") - F.col("in_progress")
    return rows.withColumn("remaining", F.greatest(F.lit(0).cast("bigint"), left))


def next_unclaimed(queue: DataFrame, state: DataFrame, n: int = 1) -> DataFrame:
    return queue.join(state.select("isbn"), "isbn", "left_anti").orderBy("pos").limit(n)


def queue_fingerprint(queue: DataFrame) -> DataFrame:
    """The first twelve hex digits of the SHA-1 of all numbers in order, one a line: changes with any number or its place.

    A digest of one text can only be taken in order, so one task does it; the rows
    stream through it sorted, and none are held.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, first = hashlib.sha1(usedforsecurity=False), True
        for batch in batches:
            if batch.num_rows:
                text = "\n".join(x or "" for x in batch.column("isbn").to_pylist())
                found.update((text if first else "\n" + text).encode())
                first = False
        yield pa.RecordBatch.from_pydict({"queue_id": [found.hexdigest()[:12]]})

    found = queue.select("isbn", "pos").repartition(1).sortWithinPartitions("pos").select("isbn").mapInArrow(digest, "queue_id string")
    nothing = F.substring(F.sha1(F.lit("").cast("binary")), 1, 12)
    return found.agg(F.coalesce(F.max("queue_id"), nothing).alias("queue_id"))


def resume_chunks(chunks: DataFrame, done: DataFrame) -> DataFrame:
    return chunks.join(done.select("chunk"), "chunk", "left_anti")


def bursts(events: DataFrame, pause: int) -> DataFrame:
    """events with ``burst``: when the run of its number's events began that no pause of so many seconds parts.

    Rows are dealt by number and day, so a busy number is no single task's work; only
    one row for each of its days meets to carry a run from day to day.
    """
    day = events.withColumn("_day", F.to_date("ts"))
    rows, days = Window.partitionBy("isbn", "_day").orderBy("ts", "event_id"), Window.partitionBy("isbn").orderBy("_day")
    ends = day.groupBy("isbn", "_day").agg(F.max("ts").alias("_end"))
    ends = ends.select("isbn", "_day", F.lag("_end").over(days).alias("_before"))
    before = F.coalesce(F.lag("ts").over(rows), F.col("_before"))
    near = F.unix_micros("ts") - F.unix_micros(before) < pause * 1_000_000
    begun = day.join(ends, ["isbn", "_day"]).withColumn("_start", F.when(~F.coalesce(near, F.lit(False)), F.col("ts")))
    carried = begun.groupBy("isbn", "_day").agg(F.max("_start").alias("_last"))
    carried = carried.select("isbn", "_day", F.max("_last").over(days.rowsBetween(Window.unboundedPreceding, -1)).alias("_open"))
    burst = F.coalesce(F.max("_start").over(rows.rowsBetween(Window.unboundedPreceding, 0)), F.col("_open"))
    return begun.join(carried, ["isbn", "_day"]).withColumn("burst", burst).drop("_day", "_before", "_start", "_open")


def lease_state(events: DataFrame, as_of: Column, ttl_seconds: int = 900) -> DataFrame:
    """(isbn, status, worker, expires_at) as the log stands at a moment.

    claim starts a lease where none runs and nothing is final; heartbeat extends a
    running one; release ends it; done and skip end it for good. An action without a
    running lease is rejected. No lease outlives a pause of its length, so each burst
    of events is folded on its own, in time order; the first that ends for good
    decides, else the last.
    """
    ttl = max(30, ttl_seconds)
    log = bursts(events.filter(F.col("ts") <= as_of), ttl).groupBy("isbn", "burst").agg(
        F.array_sort(F.collect_list(F.struct("ts", "event_id", "action", "worker"))).alias("log")
    )
    none = F.struct(
        F.lit("open").alias("status"), F.lit(None).cast("string").alias("worker"), F.lit(None).cast("timestamp").alias("until")
    )

    def step(s: Column, e: Column) -> Column:
        end = F.timestamp_seconds(F.unix_micros(e["ts"]) / 1e6 + ttl)
        running = (s["status"] == "in_progress") & (s["until"] > e["ts"])
        lease = lambda w: F.struct(F.lit("in_progress").alias("status"), w.alias("worker"), end.alias("until"))
        final = lambda name: F.struct(
            F.lit(name).alias("status"), s["worker"].alias("worker"), F.lit(None).cast("timestamp").alias("until")
        )
        return (
            F.when(s["status"].isin("done", "skipped"), s)
            .when((e["action"] == "claim") & ~F.coalesce(running, F.lit(False)), lease(e["worker"]))
            .when(running & (e["action"] == "heartbeat"), lease(s["worker"]))
            .when(running & (e["action"] == "release"), none)
            .when(running & (e["action"] == "done"), final("done"))
            .when(running & (e["action"] == "skip"), final("skipped"))
            .otherwise(s)
        )

    folded = log.select("isbn", "burst", F.aggregate("log", none, step).alias("s"))
    final_at = F.when(F.col("s.status").isin("done", "skipped"), F.col("burst"))
    ended = folded.groupBy("isbn").agg(F.coalesce(F.min_by("s", final_at), F.max_by("s", "burst")).alias("s"))
    expired = (F.col("s.status") == "in_progress") & (F.col("s.until") <= as_of)
    live = lambda c: F.when(~expired, F.col(c))
    return ended.select(
        "isbn",
        F.when(expired, "open").otherwise(F.col("s.status")).alias("status"),
        live("s.worker").alias("worker"),
        live("s.until").alias("expires_at"),
    )
