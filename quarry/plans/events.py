"""Named queries of events, sources, incremental maintenance and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions import scalars
from quarry.plans.registry import query
from quarry.session import shared_dir
from quarry.sources import reports, web
from quarry.sources.tables import table
from quarry.streaming import events as streams
from quarry.streaming import state


def _events(spark, d):
    return table(spark, d, "events")


@query("event_timeline", "SELECT event_id, event_type FROM events WHERE event_type IN ('error', 'purchase') AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' ORDER BY ts DESC, event_id LIMIT 100")
def event_timeline(spark, d):
    e = _events(spark, d).where("event_type in ('error', 'purchase') and ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-20'")
    return e.orderBy(F.desc("ts"), "event_id").limit(100).select("event_id", "event_type")


@query("event_latest_per_type", "SELECT event_type, event_id, n FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE r = 1")
def event_latest_per_type(spark, d):
    return _events(spark, d).groupBy("event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.count("*").alias("n"))


@query("event_idempotent_dedupe", "SELECT user_id, count(DISTINCT event_id) AS n FROM (SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_id % 3 = 0) GROUP BY user_id")
def event_idempotent_dedupe(spark, d):
    e = _events(spark, d)
    return streams.idempotent(e.union(e.where("event_id % 3 = 0"))).groupBy("user_id").agg(F.count("*").alias("n"))


@query("tumbling_window", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_window(spark, d):
    return streams.tumbling(_events(spark, d)).select(F.col("window.start").alias("start"), "event_type", "n")


@query("sliding_window", "SELECT day - INTERVAL 1 DAY * k AS start, event_type, count(*) AS n FROM (SELECT date_trunc('day', ts) AS day, event_type, unnest([0, 1]) AS k FROM events) GROUP BY 1, 2")
def sliding_window(spark, d):
    return streams.sliding(_events(spark, d)).select(F.col("window.start").alias("start"), "event_type", "n")


@query("session_window", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")  # fmt: skip
def session_window(spark, d):
    return streams.sessions(_events(spark, d)).select("user_id", F.col("s.start").alias("start"), "n")


@query("streaming_idempotent_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def streaming_idempotent_counts(spark, d):
    """The event table read as a stream, deduplicated by key within the watermark, counted by type; run to its end."""
    import uuid

    e = spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema).parquet(f"{d}/events.parque[t]")
    e = streams.idempotent(e.withColumn("ts", F.col("ts").cast("timestamp")), delay="60 days")
    out = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    q = e.select("event_id", "event_type").writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{out}/rows").groupBy("event_type").agg(F.count("*").alias("n"))


@query("props_json_extract", "SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, count(*) AS n FROM events GROUP BY 1")
def props_json_extract(spark, d):
    v = F.try_parse_json("props")
    return _events(spark, d).groupBy(F.try_variant_get(v, "$.k", "int").alias("k")).agg(F.count("*").alias("n"))


@query("asof_latest", """SELECT o_orderkey, event_id FROM (SELECT o_orderkey, o_custkey, TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * (o_orderkey % 40000) AS at FROM orders) o ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events GROUP BY user_id, ts) e ON o.o_custkey = e.user_id AND o.at >= e.ts""")
def asof_latest(spark, d):
    """As-of join without a range join: both sides in one stream per key, the last event carried forward."""
    at = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01").cast("timestamp")) + (F.col("o_orderkey") % 40000) * 60)
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), at.alias("ts"), "o_orderkey", F.lit(None).cast("long").alias("event_id"))
    e = _events(spark, d).groupBy(F.col("user_id").alias("k"), "ts").agg(F.max("event_id").alias("event_id")).select("k", "ts", F.lit(None).cast("long").alias("o_orderkey"), "event_id")
    w = Window.partitionBy("k").orderBy("ts", F.col("o_orderkey").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    return o.union(e).withColumn("last", F.last("event_id", ignorenulls=True).over(w)).where("o_orderkey is not null").select("o_orderkey", F.col("last").alias("event_id"))


@query("pipeline_stage_info", "SELECT event_type, max(ts) AS last_ts, sum(CAST(event_id % 97 AS BIGINT))::BIGINT AS total FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 200) GROUP BY event_type")
def pipeline_stage_info(spark, d):
    e = _events(spark, d).orderBy(F.desc("ts"), F.desc("event_id")).limit(200)
    return e.groupBy("event_type").agg(F.max("ts").alias("last_ts"), F.sum(F.col("event_id") % 97).alias("total"))


@query("source_version_state", "SELECT user_id, event_id, CASE WHEN r = 1 THEN 'ready' ELSE 'stale' END AS state FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_type = 'purchase')")
def source_version_state(spark, d):
    """The newest finished version of a source is ready, older ones are stale."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return _events(spark, d).where("event_type = 'purchase'").select("user_id", "event_id", F.when(F.row_number().over(w) == 1, "ready").otherwise("stale").alias("state"))


@query("version_timeouts", """WITH t AS (SELECT CAST(user_id AS VARCHAR) AS key, ts, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'error' THEN 3 WHEN 'purchase' THEN 4 END AS r FROM events WHERE event_type <> 'signup'),
    l AS (SELECT key, ts, r FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, r DESC) AS n FROM t) WHERE n = 1)
    SELECT key, CASE WHEN r = 2 AND epoch_ms(ts) + 3600000 < (SELECT max(epoch_ms(ts)) FROM t) THEN 'timed_out' ELSE ['queued', 'started', 'failed', 'ready'][r] END AS status, ts AS since FROM l""")  # fmt: skip
def version_timeouts(spark, d):
    """The state of each user's version by its latest transition; started ones end after an hour. The streaming form gives the same answer."""
    status = F.when(F.col("event_type") == "view", "queued").when(F.col("event_type") == "click", "started").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "ready")
    return state.version_states_batch(_events(spark, d).select(F.col("user_id").alias("key"), "ts", status.alias("status")), 3600)


@query("incremental_sync", """WITH s AS (SELECT doc_id, sha256(text || CASE WHEN doc_id % 13 = 0 THEN 'x' ELSE '' END) AS h FROM documents WHERE doc_id % 5 <> 0), k AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 7 <> 0)
    SELECT action, count(*) AS n FROM (SELECT CASE WHEN k.h IS NULL THEN 'insert' WHEN s.h IS NULL THEN 'delete' WHEN s.h <> k.h THEN 'update' ELSE 'keep' END AS action FROM s FULL JOIN k USING (doc_id)) GROUP BY action""")  # fmt: skip
def incremental_sync(spark, d):
    docs = table(spark, d, "documents")
    seen = docs.where("doc_id % 5 <> 0").select("doc_id", F.sha2(F.concat("text", F.when(F.col("doc_id") % 13 == 0, "x").otherwise("")), 256).alias("h"))
    known = docs.where("doc_id % 7 <> 0").select("doc_id", F.sha2("text", 256).alias("h"))
    return streams.sync(seen, known, "doc_id", "h").groupBy("action").agg(F.count("*").alias("n"))


@query("page_titles", r"SELECT page_id, coalesce(nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), ''), regexp_extract(url, '^[^:]+://[^/]+([^?#]*)', 1)) AS title FROM pages")
def page_titles(spark, d):
    return table(spark, d, "pages").select("page_id", web.title(F.col("html"), F.col("url")).alias("title"))


LINKS = r"""l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*href="([^"#]+)', 1)) AS h FROM pages), k AS (SELECT page_id, url, CASE WHEN regexp_matches(h, '^[a-zA-Z]+://') THEN h WHEN starts_with(h, '/') THEN regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1) || h ELSE regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1) || '/' || h END AS link FROM l)"""


@query("page_links", f"WITH {LINKS} SELECT page_id, link, count(*) AS n FROM k GROUP BY page_id, link")
def page_links(spark, d):
    return web.links(table(spark, d, "pages")).groupBy("page_id", "link").agg(F.count("*").alias("n"))


@query("url_scope", f"WITH {LINKS} SELECT page_id, count(CASE WHEN regexp_extract(link, '^([a-zA-Z]+://[^/?#]+)', 1) = regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1) AND starts_with(regexp_extract(link, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1), regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1), '[^/]*$', '')) THEN 1 END) AS n_inside, count(*) AS n FROM k GROUP BY page_id")
def url_scope(spark, d):
    return web.links(table(spark, d, "pages")).groupBy("page_id").agg(F.count_if(web.in_scope(F.col("link"), F.col("url"))).alias("n_inside"), F.count("*").alias("n"))


@query("lcov_coverage", "SELECT 'src/p' || l_partkey || '.py' AS file, CAST(count(*) AS INTEGER) AS lines, CAST(count(CASE WHEN CAST(l_quantity AS INTEGER) % 3 > 0 THEN 1 END) AS INTEGER) AS hit, 100.0::DOUBLE * count(CASE WHEN CAST(l_quantity AS INTEGER) % 3 > 0 THEN 1 END) / count(*) AS coverage FROM lineitem GROUP BY l_partkey")
def lcov_coverage(spark, d):
    """LCOV reports (one a part, from its order lines) written as text and parsed again."""
    l = table(spark, d, "lineitem")  # noqa: E741
    da = F.concat(F.lit("DA:"), F.col("l_linenumber").cast("string"), F.lit(","), (F.col("l_quantity").cast("int") % 3).cast("string"))
    text = F.concat(F.lit("TN:\nSF:./src/p"), F.col("l_partkey").cast("string"), F.lit(".py\n"), F.array_join(F.collect_list(da), "\n"), F.lit("\nend_of_record\n"))
    return reports.lcov(l.groupBy("l_partkey").agg(text.alias("content")).select(F.lit("r").alias("path"), "content"))


@query("numstat_parse", "SELECT CAST(o_orderkey AS VARCHAR) AS commit, 'src/p' || l_partkey || '.py' AS file, CAST(l_quantity AS BIGINT) AS ins, CAST(l_linenumber AS BIGINT) AS del FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def numstat_parse(spark, d):
    """A change log written as numstat text, one commit a row, and parsed again."""
    l = table(spark, d, "lineitem")  # noqa: E741
    line = F.concat_ws("\t", F.col("l_quantity").cast("long").cast("string"), F.col("l_linenumber").cast("string"), F.concat(F.lit("src/{old => p"), F.col("l_partkey").cast("string"), F.lit("}.py")))
    log = l.groupBy("l_orderkey").agg(F.concat(F.col("l_orderkey").cast("string"), F.lit("|2024|x\n"), F.array_join(F.collect_list(line), "\n")).alias("entry"))
    return reports.numstat(log).select("commit", "file", "ins", "del")


@query("snapshot_diff", "SELECT k, CASE WHEN a.h IS NULL THEN 'added' WHEN b.h IS NULL THEN 'deleted' ELSE 'changed' END AS change FROM (SELECT doc_id AS k, sha256(text) AS h FROM documents WHERE doc_id % 7 <> 1) a FULL JOIN (SELECT doc_id AS k, sha256(CASE WHEN doc_id % 11 = 0 THEN upper(lang) ELSE text END) AS h FROM documents WHERE doc_id % 7 <> 2) b USING (k) WHERE a.h IS DISTINCT FROM b.h")
def snapshot_diff(spark, d):
    """Changed and deleted files between two (path, content hash) snapshots."""
    docs = table(spark, d, "documents")
    a = docs.where("doc_id % 7 <> 1").select(F.col("doc_id").alias("k"), F.sha2("text", 256).alias("h"))
    b = docs.where("doc_id % 7 <> 2").select(F.col("doc_id").alias("k"), F.sha2(F.when(F.col("doc_id") % 11 == 0, F.upper("lang")).otherwise(F.col("text")), 256).alias("h"))
    s = streams.sync(b, a, "k", "h").where("action <> 'keep'")
    return s.select("k", F.when(F.col("action") == "insert", "added").when(F.col("action") == "delete", "deleted").otherwise("changed").alias("change"))


@query("eligible_files", """SELECT p_partkey, p FROM (SELECT p_partkey, p_size, CASE p_partkey % 8 WHEN 0 THEN 'src/' || p_partkey || '.py' WHEN 1 THEN 'node_modules/' || p_partkey || '.js' WHEN 2 THEN 'docs/.x/' || p_partkey || '.md' WHEN 3 THEN 'lib/' || p_partkey || '.bin'
    WHEN 4 THEN '.github/' || p_partkey || '.yml' WHEN 5 THEN 'd' || p_partkey || '/Makefile' WHEN 6 THEN 'src/libs/' || p_partkey || '.php' ELSE 'a.md/' || p_partkey END AS p FROM part) WHERE p_partkey % 8 IN (0, 4, 5) AND p_size * 30000 <= 1048576""")  # fmt: skip
def eligible_files(spark, d):
    """Files to index of eight kinds: by suffix, name, hidden and skipped folders, a vendor folder of its own, and size."""
    k = F.col("p_partkey").cast("string")
    kinds = [("src/", ".py"), ("node_modules/", ".js"), ("docs/.x/", ".md"), ("lib/", ".bin"), (".github/", ".yml"), ("d", "/Makefile"), ("src/libs/", ".php"), ("a.md/", "")]
    path = F.element_at(F.array(*(F.concat(F.lit(a), k, F.lit(b)) for a, b in kinds)), (F.col("p_partkey") % 8 + 1).cast("int"))
    p = table(spark, d, "part").select("p_partkey", path.alias("p"), (F.col("p_size") * 30000).alias("size"))
    return p.where(reports.eligible(F.col("p"), F.col("size"), vendored=F.array(F.lit("src/libs")))).select("p_partkey", "p")


@query("path_canonicalization", "SELECT DISTINCT 'src/' || p_brand || '/' || p_type AS path FROM part")
def path_canonicalization(spark, d):
    """Keys in four spellings, canonicalised to one survivor."""
    p = table(spark, d, "part").select(F.explode(F.array(F.concat(F.lit(".\\src\\"), "p_brand", F.lit("\\"), "p_type"), F.concat(F.lit("/src//"), "p_brand", F.lit("/./"), "p_type"), F.concat(F.lit("./src/"), "p_brand", F.lit("/"), "p_type"))).alias("x"))
    return p.select(scalars.canonical_path(F.col("x")).alias("path")).distinct()


@query("upsert_nodes", "SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN p_retailprice + 1 ELSE p_retailprice END AS price FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 5 <> 0")
def upsert_nodes(spark, d):
    """INSERT .. ON CONFLICT DO UPDATE as a full outer merge in which the new value wins."""
    p = table(spark, d, "part")
    old = p.where("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("a"))
    new = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), (F.col("p_retailprice") + 1).alias("b"))
    return old.join(new, "id", "full_outer").select("id", F.coalesce("b", "a").alias("price"))


@query("global_stats", "SELECT count(*) AS n_docs, count(DISTINCT source) AS n_sources, count(CASE WHEN lang = 'en' THEN 1 END) AS n_en, (SELECT count(*) FROM events WHERE event_type = 'error') AS n_errors FROM documents")
def global_stats(spark, d):
    s = table(spark, d, "documents").agg(F.count("*").alias("n_docs"), F.count_distinct("source").alias("n_sources"), F.count_if(F.col("lang") == "en").alias("n_en"))
    return s.crossJoin(F.broadcast(_events(spark, d).agg(F.count_if(F.col("event_type") == "error").alias("n_errors"))))  # one row each


@query("duplicate_symbol_suffix", "SELECT p_partkey, CASE WHEN r = 1 THEN p_brand ELSE p_brand || '_' || r END AS path FROM (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part)")
def duplicate_symbol_suffix(spark, d):
    """Repeated paths get _2, _3, ... in key order."""
    r = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    p = table(spark, d, "part").withColumn("r", r)
    return p.select("p_partkey", F.when(F.col("r") == 1, F.col("p_brand")).otherwise(F.concat_ws("_", "p_brand", F.col("r").cast("string"))).alias("path"))
