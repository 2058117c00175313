"""The named queries of the subpackage, one an operator, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import audit, chat, exact, html, linededup, media, mixing, neardup, quality, sentencepiece, sharding, toxicity, whiten


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir), words=4).drop("n_links", "text_hash")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir), shards=16)


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_format(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(documents(spark, sf_dir))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.encode(documents(spark, sf_dir))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_decisions(documents(spark, sf_dir))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(documents(spark, sf_dir))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_near_dedup, op3_sharding, op4_html_extraction, op5_chat_formatting, op6_source_mixing, op7_media_columns, op8_sentencepiece, op9_line_dedup, op10_toxicity, op11_exact_dedup, op12_embedding_whitening, op13_filter_audit)}

ORACLES = {
    "op2_near_dedup": """
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i+3], ' ') END AS g
              FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        df AS (SELECT g, count(*) AS f FROM s GROUP BY g),
        p AS (SELECT s.doc_id, s.g, n.n, row_number() OVER (PARTITION BY s.doc_id ORDER BY df.f, s.g) AS r FROM s JOIN df USING (g) JOIN n USING (doc_id)),
        pre AS (SELECT doc_id, g, n FROM p WHERE r <= n - ceil(0.8 * n) + 1),
        cand AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM pre AS a JOIN pre AS b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
        inter AS (SELECT c.a, c.b, count(*) AS i FROM cand AS c JOIN s AS x ON x.doc_id = c.a JOIN s AS y ON y.doc_id = c.b AND y.g = x.g GROUP BY c.a, c.b),
        links AS (SELECT a, b FROM inter JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
        e AS (SELECT a AS u, b AS v FROM links UNION SELECT b, a FROM links),
        r(u, v) AS (SELECT u, u FROM e UNION SELECT r.u, e.v FROM r JOIN e ON e.u = r.v),
        c AS (SELECT u, min(v) AS c FROM r GROUP BY u)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.c, d.doc_id) AS component_id, coalesce(c.c, d.doc_id) = d.doc_id AS kept
        FROM documents AS d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.u = d.doc_id
    """,
    "op5_chat_formatting": """
        WITH base AS (SELECT conv_id, turn, coalesce(lower(trim(role)), 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
        c AS (SELECT conv_id, count(*) AS n, list({'r': role, 't': text} ORDER BY turn ASC NULLS FIRST, role, text) AS turns FROM base GROUP BY conv_id),
        d AS (SELECT n, turns, min(conv_id) AS conv_id, count(*) AS n_equal FROM c GROUP BY n, turns),
        k AS (SELECT * FROM d WHERE NOT EXISTS (SELECT 1 FROM d AS e WHERE e.n > d.n AND e.turns[1] = d.turns[1] AND e.turns[1:d.n] = d.turns)),
        r AS (SELECT conv_id, n, n_equal, array_to_string(list_transform(turns, lambda x: '<|' || x.r || '|>' || chr(10) || x.t || chr(10) || '<|end|>'), chr(10)) AS rendered FROM k)
        SELECT conv_id, n AS n_turns, n_equal, CAST(length(rendered) AS BIGINT) AS n_chars, rendered FROM r
    """,
    "op11_exact_dedup": """
        WITH r AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        ends AS (SELECT min(doc_id) AS low, max(doc_id) AS high FROM documents)
        SELECT r.doc_id, g.keep_id, g.n AS group_size, r.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(r.text) AS text_sha256, coalesce(r.doc_id > (low + high) // 2, false) AS in_history
        FROM r JOIN (SELECT text, max(doc_id) AS keep_id, count(*) AS n FROM r GROUP BY text) AS g USING (text), ends
    """,
    "op13_filter_audit": """
        WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
        w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
        l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
        f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                     CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
                     || CASE WHEN 100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 3 * length(t) THEN 'C' ELSE '' END
                     || CASE WHEN length(translate(t, '#$%&*|', '')) < length(t) THEN 'D' ELSE '' END || CASE WHEN doc_id > first THEN 'E' ELSE '' END AS fails
              FROM w LEFT JOIN l USING (doc_id)),
        c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
        a(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
        o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM a, a AS b, a AS c, a AS d, a AS e
              WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
        s AS (SELECT part, filter_order, step, substr(filter_order, step, 1) AS x, fails, n, good, toxic,
                     contains(fails, substr(filter_order, step, 1)) AS hit, translate(fails, substr(filter_order, 1, step - 1), '') <> fails AS gone
              FROM c, o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
        m AS (SELECT part, filter_order, step, x, coalesce(sum(n) FILTER (NOT hit AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (hit AND NOT gone), 0) AS removed,
                     coalesce(sum(n) FILTER (hit AND gone), 0) AS redundant, coalesce(sum(n) FILTER (fails = x), 0) AS unique_fails,
                     coalesce(sum(good) FILTER (hit AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (hit AND NOT gone), 0) AS toxic_lost
              FROM s GROUP BY part, filter_order, step, x)
        SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
               CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM m
    """,
}
