"""Merges, worklists, queues and leases."""

import uuid

from pyspark.sql import functions as F

from shelfmerge.operators import extract, merge, worklist
from shelfmerge.operators.texts import with_texts
from shelfmerge.plans import duck as d
from shelfmerge.plans.base import query
from shelfmerge.plans.fixtures import LEASE_EVENTS, QUERIES, QUEUE, listings, lease_events, queries_table, queue, shared_folder, texts, with_book_std
from shelfmerge.streaming import jobs

NOW = "TIMESTAMP '2025-01-01 00:00:00'"


def now():
    return F.lit("2025-01-01 00:00:00").cast("timestamp")


FIELDS = ["isbn", "titulo", "autor"]
UPDATES = f"""SELECT site, url, isbn, 'new ' || coalesce(titulo, '') AS titulo, '' AS autor, pk * 2 AS seq FROM book_std WHERE h % 3 = 0
UNION ALL SELECT site, url || '/x', isbn, titulo, autor, pk * 2 FROM book_std WHERE h % 7 = 0
UNION ALL SELECT site, url || '/x', isbn, 'later', autor, pk * 2 + 1 FROM book_std WHERE h % 14 = 0
UNION ALL SELECT site, url, isbn, 'last ' || coalesce(titulo, ''), autor, pk * 2 + 1 FROM book_std WHERE h % 6 = 0
UNION ALL SELECT site, '', isbn, titulo, autor, pk FROM book_std WHERE h % 11 = 0"""


def updates(spark, sf):
    listings(spark, sf).createOrReplaceTempView("book_std")
    return spark.sql(UPDATES)


def target(spark, sf):
    return listings(spark, sf).select("site", "url", *FIELDS, "updated_at")


def upserted(spark, sf):
    return merge.upsert_listings(target(spark, sf), updates(spark, sf), now())


UPSERT = with_book_std("SELECT 1").replace(" SELECT 1", f""", u AS (SELECT *, row_number() OVER (PARTITION BY site, url ORDER BY seq DESC) AS r, count(*) OVER (PARTITION BY site, url) AS times
FROM ({UPDATES}) WHERE site <> '' AND url <> ''), l AS (SELECT * FROM u WHERE r = 1) """)


@query(UPSERT + f"""SELECT b.site, b.url, CASE WHEN l.url IS NULL THEN b.isbn ELSE l.isbn END AS isbn, CASE WHEN l.url IS NULL THEN b.titulo ELSE l.titulo END AS titulo,
CASE WHEN l.url IS NULL THEN b.autor ELSE l.autor END AS autor, CAST(CASE WHEN l.url IS NULL THEN b.updated_at ELSE {NOW} END AS VARCHAR) AS updated_at
FROM book_std b LEFT JOIN l ON l.site = b.site AND l.url = b.url
UNION ALL SELECT l.site, l.url, l.isbn, l.titulo, l.autor, CAST({NOW} AS VARCHAR) FROM l WHERE NOT EXISTS (SELECT 1 FROM book_std b WHERE b.site = l.site AND b.url = l.url)""")
def upsert_listings(spark, sf):
    return upserted(spark, sf).drop("_inserted", "_updated").withColumn("updated_at", F.col("updated_at").cast("string"))


@query(UPSERT + """SELECT sum(CASE WHEN o THEN 0 ELSE 1 END)::BIGINT AS inserted, sum(times - CASE WHEN o THEN 0 ELSE 1 END)::BIGINT AS updated
FROM (SELECT l.*, EXISTS (SELECT 1 FROM book_std b WHERE b.site = l.site AND b.url = l.url) AS o FROM l)""")
def upsert_counts(spark, sf):
    return merge.upsert_counts(upserted(spark, sf))


@query(with_book_std("""SELECT site, url, CASE WHEN h % 4 = 0 THEN isbn || '-' ELSE isbn END AS isbn, CAST(NULL AS VARCHAR) AS titulo FROM book_std WHERE h % 2 = 0
UNION ALL SELECT site, url, isbn, titulo FROM book_std WHERE h % 2 <> 0"""))
def merge_tables(spark, sf):
    std = listings(spark, sf)
    dst = std.filter("h % 2 <> 0 or h % 3 = 0").select("site", "url", "isbn", "titulo")
    src = std.filter("h % 2 = 0").select("site", "url", "isbn", "autor", F.lit(1).alias("seq"))
    again = src.withColumns({"isbn": F.when(F.col("isbn") != "z", F.concat("isbn", F.lit("-"))), "seq": F.lit(2)})
    again = again.join(std.filter("h % 4 = 0").select("site", "url"), ["site", "url"], "left_semi")
    return merge.merge_tables(dst, again.unionByName(src), order="seq")


SRC = "src AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY isbn ORDER BY sk) AS r FROM book_std WHERE site = 'amazon_books' AND isbn <> '') WHERE r = 1)"
FILLED = ", ".join(f"CASE WHEN s.url IS NOT NULL AND {d.blank('b.' + c)} AND NOT {d.blank('s.' + c)} THEN trim(s.{c}) ELSE b.{c} END AS {c}" for c in merge.ENRICHED)


@query(with_book_std("SELECT 1").replace(" SELECT 1", f", {SRC} SELECT b.site, b.url, {FILLED}, s.url IS NOT NULL AS matched FROM book_std b LEFT JOIN src s ON s.isbn = b.isbn AND b.site <> 'amazon_books'"))
def enrich(spark, sf):
    std = listings(spark, sf)
    src = std.filter("site = 'amazon_books'").withColumn("seq", F.col("sk"))
    out = merge.enrich(std, src, now()).select("site", "url", *merge.ENRICHED, F.col("_matched").alias("matched"))
    return with_texts(out, texts(spark, sf), "sinopsis")


@query(with_book_std("""SELECT site, url, CASE WHEN bad THEN 'Rústica' ELSE encuadernacion END AS encuadernacion, bad AS changed, CASE WHEN h % 9 = 1 THEN
'{"raw":{"ENCUADERNACION":"Rstica"},"std":{"T":1,"ENCUADERNACION":"Rústica"}}' ELSE '{}' END AS raw_json FROM (SELECT *, coalesce(lower(trim(encuadernacion)) IN ('rstica', 'rustica'), false) AS bad FROM book_std)"""))
def repair_binding_typos(spark, sf):
    raw = F.when(F.col("h") % 9 == 1, '{"raw":{"ENCUADERNACION":"Rstica"},"std":{"T":1,"ENCUADERNACION":"Rstica"}}').otherwise("{}")
    out = merge.repair_binding_typos(listings(spark, sf).withColumn("raw_json", raw), now())
    return out.select("site", "url", "encuadernacion", (F.col("updated_at") == now()).alias("changed"), "raw_json")


# ---- worklists

LINES = f"""q AS ({QUERIES}), t AS (SELECT line_no, trim(raw) AS raw FROM q),
f AS (SELECT line_no, raw, trim(regexp_extract(raw, '^([^\\t;|,]*)', 1)) AS field, regexp_extract(raw, '^(\\S+)', 1) AS word FROM t),
i AS (SELECT line_no, {d.isbn("CASE WHEN length(" + d.isbn("field") + ") IN (10, 13) THEN field ELSE word END")} AS isbn FROM f)"""


@query(f"WITH {LINES} SELECT isbn, min(line_no) AS line_no FROM i WHERE length(isbn) IN (10, 13) GROUP BY isbn")
def read_isbn_list(spark, sf):
    return worklist.isbn_lines(queries_table(spark, sf))


@query(f"WITH {LINES} SELECT isbn, min(line_no) AS line_no FROM (SELECT * FROM i WHERE length(isbn) IN (10, 13) ORDER BY line_no LIMIT 40) GROUP BY isbn")
def read_isbn_list_limited(spark, sf):
    return worklist.isbn_lines(queries_table(spark, sf), limit=40)


DIG = lambda c: f"regexp_replace({c}, '[^0-9Xx]', '', 'g')"
ITEMS = f"""WITH {LINES}, c AS (SELECT line_no, raw, CASE WHEN contains(raw, '|') THEN strpos(raw, '|') ELSE strpos(raw, chr(9)) END AS cut FROM t WHERE raw <> ''),
s AS (SELECT line_no, raw, cut, CASE WHEN cut > 0 THEN trim(substr(raw, 1, cut - 1)) ELSE raw END AS l, CASE WHEN cut > 0 THEN trim(substr(raw, cut + 1)) END AS r FROM c),
m AS (SELECT line_no, raw, CASE WHEN length({DIG("l")}) >= 8 THEN {DIG("l")} WHEN length({DIG("r")}) >= 8 THEN {DIG("r")} END AS isbn,
CASE WHEN cut = 0 THEN CASE WHEN length({DIG("l")}) < 8 THEN raw END WHEN r <> '' AND (length({DIG("l")}) >= 8 OR length({DIG("r")}) < 8) THEN r END AS title FROM s)
SELECT line_no, raw, isbn, title FROM m WHERE isbn IS NOT NULL OR title IS NOT NULL"""


@query(ITEMS)
def parse_query_items(spark, sf):
    return worklist.parse_query_items(queries_table(spark, sf)).drop("url")


@query(f"WITH q AS ({QUERIES}) SELECT line_no AS pos, {d.isbn('raw')} AS isbn, 'https://www.amazon.com/s?k=' || {d.isbn('raw')} || '&i=stripbooks' AS amazon_search_url FROM q WHERE {d.isbn('raw')} <> ''")
def read_queue(spark, sf):
    empty = [F.lit("").alias(c) for c in ("site", "url", "titulo", "amazon_search_url")]
    rows = queries_table(spark, sf).select(F.col("line_no").alias("pos"), F.col("raw").alias("isbn"), *empty)
    return worklist.queue_rows(rows, from_text=True).select("pos", "isbn", "amazon_search_url")


def asked(spark, sf):
    return worklist.isbn_lines(queries_table(spark, sf))


ASKED = f"asked AS (SELECT isbn, min(line_no) AS line_no FROM i WHERE length(isbn) IN (10, 13) GROUP BY isbn)"
HAVE = "SELECT isbn FROM book_std WHERE isbn <> '' AND h % 4 = 1"


def with_both(sql: str) -> str:
    return with_book_std("SELECT 1").replace(" SELECT 1", f", {LINES}, {ASKED} {sql}")


def have(spark, sf):
    return listings(spark, sf).filter("h % 4 = 1")


@query(with_both(f"SELECT DISTINCT isbn FROM asked WHERE isbn IN ({HAVE})"))
def isbns_present(spark, sf):
    return worklist.isbns_present(have(spark, sf), asked(spark, sf))


@query(with_both(f"SELECT line_no, raw FROM (SELECT line_no, raw, {d.isbn('field')} AS k FROM f) WHERE length(k) NOT IN (10, 13) OR k NOT IN ({HAVE})"))
def missing_queries(spark, sf):
    return worklist.missing_queries(queries_table(spark, sf), have(spark, sf)).select("line_no", F.trim("raw").alias("raw"))


@query(f"WITH q AS ({QUERIES}) SELECT DISTINCT regexp_replace(raw, '[^0-9]', '', 'g') AS isbn FROM q WHERE length(regexp_replace(raw, '[^0-9]', '', 'g')) IN (10, 13)")
def accumulate_remaining(spark, sf):
    q = queries_table(spark, sf)
    return worklist.accumulate_remaining(q.filter("line_no % 3 < 2"), q.filter("line_no % 3 > 0"))


@query(with_book_std("SELECT site, url, autor, NULL AS titulo FROM book_std WHERE h % 2 = 0 UNION ALL SELECT site, url, NULL, titulo FROM book_std WHERE h % 2 = 1"))
def combine_sources(spark, sf):
    std = listings(spark, sf)
    return worklist.combine_sources(std.filter("h % 2 = 0").select("site", "url", "autor"), std.filter("h % 2 = 1").select("site", "url", "titulo"))


@query(with_book_std("SELECT site, url FROM book_std WHERE h % 5 <> 2"))
def unseen(spark, sf):
    std = listings(spark, sf).select("site", "url", "h")
    return worklist.unseen(std.select("site", "url"), std.filter("h % 5 = 2"))


RANKED = "SELECT isbn, site, url, sk % 7 AS source_rank, sk AS seq FROM book_std WHERE isbn <> ''"


def ranked(spark, sf):
    return listings(spark, sf).filter("isbn <> ''").selectExpr("isbn", "site", "url", "sk % 7 AS source_rank", "sk AS seq")


@query(with_both(f"SELECT isbn, site, url, source_rank FROM ({RANKED}) s WHERE isbn IN (SELECT isbn FROM asked) AND source_rank = (SELECT min(sk % 7) FROM book_std b WHERE b.isbn = s.isbn)"))
def cascade(spark, sf):
    return worklist.cascade(asked(spark, sf), ranked(spark, sf)).drop("seq")


@query(with_both(f"SELECT isbn, arg_min(url, source_rank * 1000000 + seq) AS url FROM ({RANKED}) WHERE isbn IN (SELECT isbn FROM asked) GROUP BY isbn"))
def cascade_single(spark, sf):
    return worklist.cascade(asked(spark, sf), ranked(spark, sf), single=True).select("isbn", "url")


@query(with_both(f"""SELECT r AS source_rank, count(*) FILTER (WHERE best IS NULL OR best >= r) AS submitted, count(*) FILTER (WHERE best = r) AS found, count(*) FILTER (WHERE best IS NULL OR best > r) AS remaining
FROM (SELECT a.isbn, min(s.source_rank) AS best FROM asked a LEFT JOIN ({RANKED}) s ON s.isbn = a.isbn GROUP BY a.isbn), range(7) t(r) GROUP BY r"""))
def cascade_stages(spark, sf):
    out = worklist.cascade_stages(asked(spark, sf), ranked(spark, sf), list(range(7)))
    return out.withColumn("source_rank", F.col("source_rank").cast("bigint"))


@query(with_both(f"""SELECT chunk, count(*) AS submitted, count(*) FILTER (WHERE isbn IN ({HAVE})) AS found, count(*) FILTER (WHERE isbn NOT IN ({HAVE})) AS missing,
round(count(*) FILTER (WHERE isbn IN ({HAVE})) / count(*), 4) AS rate FROM (SELECT *, (row_number() OVER (ORDER BY line_no) - 1) // 50 + 1 AS chunk FROM asked) GROUP BY chunk"""))
def coverage(spark, sf):
    return worklist.coverage(worklist.chunk_worklist(asked(spark, sf)), have(spark, sf))


@query(f"WITH q AS ({QUERIES}) SELECT line_no, raw, (row_number() OVER (ORDER BY line_no) - 1) // 37 + 1 AS chunk FROM q WHERE line_no % 10 <> 3")
def chunk_worklist(spark, sf):
    return worklist.chunk_worklist(queries_table(spark, sf).filter("line_no % 10 <> 3").drop("chunk"), 37)


@query("SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN contains(url, '#') THEN 'skipped' WHEN length(html) < 2000 THEN 'errors' ELSE 'written' END AS outcome FROM pages) GROUP BY outcome")
def crawl_stats(spark, sf):
    outcome = F.when(F.col("url").contains("#"), "skipped").when(F.length("html") < 2000, "errors").otherwise("written")
    return worklist.crawl_stats(spark.read.parquet(f"{sf}/pages.parquet").withColumn("outcome", outcome))


@query("SELECT url, 'no title' AS reason FROM pages WHERE regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1) = '' UNION ALL SELECT url, 'short' FROM pages WHERE regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1) <> '' AND length(html) < 3000")
def dead_letters(spark, sf):
    rows = spark.read.parquet(f"{sf}/pages.parquet")
    found = extract.extract_fields(rows).join(rows.select("page_id", F.length("html").alias("n")), "page_id")
    return worklist.dead_letters(found.withColumn("reason", F.when(F.col("titulo") == "", "no title").when(F.col("n") < 3000, "short")))


@query(f"SELECT chunk, count(*) AS n FROM ({QUERIES}) WHERE chunk % 3 <> 0 GROUP BY chunk")
def resume_chunks(spark, sf):
    chunks = queries_table(spark, sf).groupBy("chunk").agg(F.count("*").alias("n"))
    return worklist.resume_chunks(chunks, chunks.filter("chunk % 3 = 0"))


@query(with_book_std("SELECT isbn, site, url FROM (SELECT *, row_number() OVER (PARTITION BY isbn ORDER BY sk, url) AS r FROM book_std) WHERE r = 1"))
def dedupe_keep_first(spark, sf):
    return worklist.dedupe_keep_first(listings(spark, sf), ["isbn"], "sk", "url").select("isbn", "site", "url")


# ---- queue and leases

AS_OF = "2024-01-03 12:00:00"
LEASE = f"""WITH RECURSIVE ev AS (SELECT isbn, ts, action, worker, row_number() OVER (PARTITION BY isbn ORDER BY ts, event_id) AS n FROM ({LEASE_EVENTS}) WHERE ts <= TIMESTAMP '@@'),
st AS (SELECT DISTINCT isbn, CAST(0 AS BIGINT) AS n, 'open' AS status, CAST(NULL AS VARCHAR) AS worker, CAST(NULL AS TIMESTAMP) AS until FROM ev
UNION ALL SELECT e.isbn, e.n,
 CASE WHEN s.status IN ('done', 'skipped') THEN s.status WHEN e.action = 'claim' THEN 'in_progress' WHEN NOT live THEN s.status
  WHEN e.action = 'release' THEN 'open' WHEN e.action = 'done' THEN 'done' WHEN e.action = 'skip' THEN 'skipped' ELSE s.status END,
 CASE WHEN s.status IN ('done', 'skipped') THEN s.worker WHEN e.action = 'claim' AND NOT live THEN e.worker WHEN live AND e.action = 'release' THEN NULL ELSE s.worker END,
 CASE WHEN s.status IN ('done', 'skipped') THEN s.until WHEN e.action = 'claim' AND NOT live THEN e.ts + INTERVAL 900 SECOND WHEN live AND e.action = 'heartbeat' THEN e.ts + INTERVAL 900 SECOND
  WHEN live AND e.action IN ('release', 'done', 'skip') THEN NULL ELSE s.until END
 FROM (SELECT st.*, e.action, e.worker AS ew, e.ts, e.n AS en, coalesce(st.status = 'in_progress' AND st.until > e.ts, false) AS live FROM st JOIN ev e ON e.isbn = st.isbn AND e.n = st.n + 1) x,
 LATERAL (SELECT x.isbn, x.en AS n, x.action, x.ew AS worker, x.ts) e, LATERAL (SELECT x.status, x.worker, x.until) s),
fin AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY isbn ORDER BY n DESC) AS r FROM st) WHERE r = 1),
leases AS (SELECT isbn, CASE WHEN gone THEN 'open' ELSE status END AS status, CASE WHEN NOT gone THEN worker END AS worker, CASE WHEN NOT gone THEN epoch_us(until) END AS until_us
 FROM (SELECT *, coalesce(status = 'in_progress' AND until <= TIMESTAMP '@@', false) AS gone FROM fin))"""


def leases(spark, sf, as_of=AS_OF):
    return worklist.lease_state(lease_events(spark, sf), F.lit(as_of).cast("timestamp"))


def lease_query(as_of):
    def run(spark, sf):
        return leases(spark, sf, as_of).select("isbn", "status", "worker", F.unix_micros("expires_at").alias("until_us"))

    return run


query(LEASE.replace("@@", AS_OF) + " SELECT * FROM leases", "lease_state")(lease_query(AS_OF))
query(LEASE.replace("@@", "2024-02-01 00:00:00") + " SELECT * FROM leases", "lease_state_last")(lease_query("2024-02-01 00:00:00"))



@query(LEASE.replace("@@", AS_OF) + " SELECT * FROM leases")
def lease_stream(spark, sf):
    """The log as a stream, its changes written, and the state at the moment read from them."""
    path = f"{shared_folder(spark)}/shelfmerge/leases-{uuid.uuid4().hex}"
    log = lease_events(spark, sf)
    log.write.parquet(f"{path}/in")
    changes = jobs.lease_stream(spark.readStream.schema(log.schema).parquet(f"{path}/in"))
    changes.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start(f"{path}/out", "parquet").awaitTermination()
    at = jobs.leases_at(spark.read.schema(changes.schema).parquet(f"{path}/out"), F.lit(AS_OF).cast("timestamp"))
    every = log.filter(F.col("ts") <= F.lit(AS_OF).cast("timestamp")).select("isbn").distinct().join(at, "isbn", "left")
    return every.select("isbn", F.coalesce("status", F.lit("open")).alias("status"), "worker", F.unix_micros("expires_at").alias("until_us"))


STATUS = LEASE.replace("@@", AS_OF) + f", q AS ({QUEUE}), status AS (SELECT q.isbn, q.pos, coalesce(nullif(l.status, 'open'), 'open') AS status FROM q LEFT JOIN leases l ON l.isbn = q.isbn)"


def held(spark, sf):
    return leases(spark, sf).filter("status <> 'open'")


@query(STATUS + " SELECT isbn, pos, status FROM status")
def queue_status(spark, sf):
    return worklist.queue_status(queue(spark, sf), held(spark, sf)).withColumn("pos", F.col("pos").cast("bigint"))


@query(STATUS + """ SELECT count(*) AS total, count(*) FILTER (WHERE status = 'done') AS done, count(*) FILTER (WHERE status = 'skipped') AS skipped, count(*) FILTER (WHERE status = 'in_progress') AS in_progress,
count(*) FILTER (WHERE status = 'open') AS remaining FROM status""")
def queue_stats(spark, sf):
    return worklist.queue_stats(worklist.queue_status(queue(spark, sf), held(spark, sf)))


@query(STATUS + " SELECT isbn, pos FROM status WHERE status = 'open' ORDER BY pos LIMIT 3")
def next_unclaimed(spark, sf):
    return worklist.next_unclaimed(queue(spark, sf), held(spark, sf), 3).withColumn("pos", F.col("pos").cast("bigint"))


@query(STATUS + " SELECT isbn, status FROM leases WHERE status <> 'open' AND isbn IN (SELECT isbn FROM q)")
def state_of_queue(spark, sf):
    return worklist.state_of_queue(held(spark, sf), queue(spark, sf)).select("isbn", "status")


@query(f"SELECT substr(sha1(string_agg(isbn, chr(10) ORDER BY pos)), 1, 12) AS queue_id FROM ({QUEUE})")
def queue_fingerprint(spark, sf):
    return worklist.queue_fingerprint(queue(spark, sf))


@query("SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_counts(spark, sf):
    rows = jobs.stream_counts(spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")), "1 hour")
    return rows.select(F.unix_micros("window_start").alias("start_us"), "event_type", "n")
