"""Named queries of search and retrieval."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.operators import chunking, search, textindex, vectorindex
from quarry.operators.iterate import materialize
from quarry.plans.registry import query
from quarry.session import shared_dir
from quarry.sources.tables import table

FTS = """t AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[a-z]+') AS t FROM documents),
    sc AS (SELECT id, CAST(len(list_filter(t, lambda x: x IN ('the', 'and'))) AS DOUBLE) / len(t) AS fts_score FROM t WHERE list_contains(t, 'the') AND list_contains(t, 'and')),
    fts AS (SELECT id, fts_score, row_number() OVER (ORDER BY fts_score DESC, id) AS fts_rank FROM sc QUALIFY fts_rank <= 50)"""
VEC = """q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0),
    vs AS (SELECT vec_id AS id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) AS vector_score FROM embeddings, q WHERE vec_id <> 0),
    vec AS (SELECT id, vector_score, row_number() OVER (ORDER BY vector_score DESC, id) AS vector_rank FROM vs QUALIFY vector_rank <= 50)"""


def _query_vector(spark, d):
    return table(spark, d, "embeddings").where("vec_id = 0").select(F.col("embedding").alias("q"))


def _vectors(spark, d):
    return table(spark, d, "embeddings").where("vec_id <> 0")


@query("hybrid_search", f"""WITH {FTS}, {VEC}
    SELECT id, fts_rank, vector_rank, coalesce(1.0::DOUBLE / (60 + fts_rank), 0) + coalesce(1.0::DOUBLE / (60 + vector_rank), 0) AS rrf_score FROM fts FULL JOIN vec USING (id)
    ORDER BY rrf_score DESC, fts_rank ASC NULLS LAST, vector_rank ASC NULLS LAST, id LIMIT 20""")  # fmt: skip
def hybrid_search(spark, d):
    hits = search.hybrid(table(spark, d, "documents"), _vectors(spark, d), _query_vector(spark, d), ["the", "and"])
    return hits.select("id", F.col("fts_rank").cast("long"), F.col("vector_rank").cast("long"), "rrf_score")


ALLOWED = "doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) OR source = 'src1'"


@query("hybrid_search_allowed", f"""WITH ok AS (SELECT doc_id FROM documents WHERE {ALLOWED}),
    {FTS.replace("FROM documents)", "FROM documents WHERE doc_id IN (SELECT doc_id FROM ok))")}, {VEC.replace("vec_id <> 0)", "vec_id <> 0 AND vec_id IN (SELECT doc_id FROM ok))")}
    SELECT id, fts_rank, vector_rank, coalesce(1.0::DOUBLE / (60 + fts_rank), 0) + coalesce(1.0::DOUBLE / (60 + vector_rank), 0) AS rrf_score FROM fts FULL JOIN vec USING (id)
    ORDER BY rrf_score DESC, fts_rank ASC NULLS LAST, vector_rank ASC NULLS LAST, id LIMIT 20""")  # fmt: skip
def hybrid_search_allowed(spark, d):
    """Hybrid search of a user who may see labelled good documents and one source: the filter comes before the ranks."""
    docs = table(spark, d, "documents")
    good = table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    ok = docs.where("source = 'src1'").select(F.col("doc_id").alias("id")).union(good)
    hits = search.hybrid(docs, _vectors(spark, d), _query_vector(spark, d), ["the", "and"], allowed=ok)
    return hits.select("id", F.col("fts_rank").cast("long"), F.col("vector_rank").cast("long"), "rrf_score")


@query("relevant_communities", """WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0),
    c AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS x, count(*) AS n FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY label, i),
    m AS (SELECT label, max(n) AS n_members, list(x ORDER BY i) AS e FROM c GROUP BY label)
    SELECT community, n_members, round(relevance, 9) AS relevance, rank FROM (SELECT label AS community, n_members, list_cosine_similarity(e, q) AS relevance, row_number() OVER (ORDER BY list_cosine_similarity(e, q) DESC, label) AS rank FROM m, q) WHERE rank <= 5""")  # fmt: skip
def relevant_communities(spark, d):
    """The five communities (labels, by the mean of their vectors) most similar to a query vector."""
    c = search.mean_vectors(table(spark, d, "embeddings"), "label").withColumnRenamed("label", "community")
    return search.relevant_communities(c, _query_vector(spark, d), 5).select("community", "n_members", F.round("relevance", 9).alias("relevance"), F.col("rank").cast("long"))


@query("search_nodes", """WITH h AS (SELECT url AS uri, page_id AS rank FROM pages), k AS (SELECT rank, uri AS natural_key FROM h UNION SELECT rank, regexp_replace(regexp_replace(uri, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*/', ''), '[?#].*$', '') FROM h),
    n AS (SELECT page_id AS id, CASE WHEN page_id % 2 = 0 THEN url ELSE regexp_replace(regexp_replace(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*/', ''), '[?#].*$', '') END AS natural_key FROM pages)
    SELECT id, min(rank) AS rank FROM k JOIN n USING (natural_key) GROUP BY id ORDER BY rank, id LIMIT 20""")  # fmt: skip
def search_nodes(spark, d):
    """Graph nodes of pages that search hits name by address or by path, the first twenty."""
    p = table(spark, d, "pages")
    path = F.regexp_replace(F.regexp_replace("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*/", ""), r"[?#].*$", "")
    nodes = p.select(F.col("page_id").alias("id"), F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(path).alias("natural_key"))
    return search.search_nodes(p.select(F.col("url").alias("uri"), F.col("page_id").alias("rank")), nodes)


@query("fts_topk", f"WITH {FTS} SELECT id, fts_rank FROM fts")
def fts_topk(spark, d):
    return search.full_text(table(spark, d, "documents"), ["the", "and"]).select("id", F.col("fts_rank").cast("long"))


@query("vector_topk", f"WITH {VEC} SELECT id, vector_rank FROM vec")
def vector_topk(spark, d):
    return search.vector_search(_vectors(spark, d), _query_vector(spark, d)).select("id", F.col("vector_rank").cast("long"))


@query("indexed_search", """WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS w, generate_subscripts(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), 1) AS p FROM documents),
    o AS (SELECT doc_id, w, p, lag(w) OVER (PARTITION BY doc_id ORDER BY p) AS w0, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS p0 FROM w WHERE w IN ('é', 'è')),
    s AS (SELECT doc_id AS id, sum(0.1::DOUBLE / (p - p0)) AS score FROM o WHERE w <> w0 GROUP BY doc_id)
    SELECT id, round(score, 9) AS score FROM (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS r FROM s) WHERE r <= 50""")  # fmt: skip
def indexed_search(spark, d):
    """The best 50 documents with both words by cover density, from an inverted index over all documents."""
    path = f"{shared_dir(spark)}/text-index-{uuid.uuid4().hex}"
    textindex.build(table(spark, d, "documents"), path)
    return textindex.search(spark, path, "é è", 50).select("id", F.round("score", 9).alias("score"))


@query("vector_neighbors")
def vector_neighbors(spark, d):
    """The ten nearest vectors of every tenth one, from an index of cells; recall measured in tests."""
    path = f"{shared_dir(spark)}/vector-index-{uuid.uuid4().hex}"
    e = table(spark, d, "embeddings")
    vectorindex.build(e, path, 16)
    return vectorindex.nearest(spark, path, e.where("vec_id % 10 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q")), 10, 11)


@query("chunk_details", """SELECT d.doc_id, i AS chunk_index, sha256(substr(d.text, i * 1300 + 1, 1500)) AS chunk_hash, d.source, d.lang
    FROM (SELECT *, unnest(range(0, CAST(greatest(ceil((length(text) - 200) / 1300.0), 1) AS BIGINT))) AS i FROM documents WHERE text IS NOT NULL) d""")  # fmt: skip
def chunk_details(spark, d):
    docs = table(spark, d, "documents")
    return search.fixed_chunks(docs).join(docs.select("doc_id", "source", "lang"), "doc_id").select("doc_id", F.col("chunk_index").cast("long"), "chunk_hash", "source", "lang")


@query("document_chunks")
def document_chunks(spark, d):
    """Recursive chunks of every document with whole fences; tested by brute force on whole documents."""
    return chunking.document_chunks(table(spark, d, "documents"), ["doc_id"]).select("doc_id", "chunk_index", F.char_length("content").alias("n_chars"), "chunk_hash")


@query("header_sections")
def header_sections(spark, d):
    """Documents with their first line as a header, cut at headers and then by size; tested by brute force."""
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("# "), F.regexp_replace("text", "\n\n", "\n## part\n")).alias("text"))
    return chunking.header_chunks(docs, ["doc_id"]).select("doc_id", "chunk_index", "headers", "chunk_hash")


@query("symbol_chunks", """WITH f AS (SELECT l_orderkey, l_linenumber, 'def line_' || l_linenumber || '():' || chr(10) || '    return ' || l_partkey AS body FROM lineitem),
    n AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, body) - 1 AS chunk_index, 'line_' || l_linenumber AS symbol_name, 'function' AS symbol_kind, body FROM f)
    SELECT l_orderkey, CAST(chunk_index AS INTEGER) AS chunk_index, symbol_name, symbol_kind, sha256(body) AS chunk_hash FROM n
    UNION ALL SELECT l_orderkey, CAST(count(*) AS INTEGER), '__module__', 'module', sha256('import shop') FROM f GROUP BY l_orderkey""")  # fmt: skip
def symbol_chunks(spark, d):
    """An order as a Python module with a function a line, chunked at the borders of its functions."""
    body = F.concat(F.lit("def line_"), "l_linenumber", F.lit("():\n    return "), "l_partkey")
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", body.alias("body")))).alias("f"))
    files = lines.select("l_orderkey", F.concat(F.lit("orders/o"), "l_orderkey", F.lit(".py")).alias("path"), F.concat(F.lit("import shop\n\n\n"), F.array_join(F.transform("f", lambda x: x["body"]), "\n\n\n")).alias("content"))
    return chunking.symbol_chunks(files, ["l_orderkey"]).select("l_orderkey", "chunk_index", "symbol_name", "symbol_kind", "chunk_hash")


@query("chunk_hash_diff", """WITH c AS (SELECT doc_id, text, unnest(range(0, CAST(greatest(ceil((length(text) - 200) / 1300.0), 1) AS BIGINT))) AS i FROM documents WHERE text IS NOT NULL),
    o AS (SELECT DISTINCT doc_id, sha256(substr(text, i * 1300 + 1, 1500)) AS chunk_hash FROM c),
    m AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN text || ' changed' ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0 AND text IS NOT NULL),
    c2 AS (SELECT doc_id, text, unnest(range(0, CAST(greatest(ceil((length(text) - 200) / 1300.0), 1) AS BIGINT))) AS i FROM m),
    n AS (SELECT DISTINCT doc_id, sha256(substr(text, i * 1300 + 1, 1500)) AS chunk_hash FROM c2)
    SELECT doc_id, chunk_hash, CASE WHEN o.doc_id IS NULL THEN 'add' WHEN n.doc_id IS NULL THEN 'delete' ELSE 'keep' END AS status FROM o FULL JOIN n USING (doc_id, chunk_hash)""")  # fmt: skip
def chunk_hash_diff(spark, d):
    docs = table(spark, d, "documents")
    new = docs.where("doc_id % 7 <> 0").withColumn("text", F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit(" changed"))).otherwise(F.col("text")))
    return search.chunk_diff(search.fixed_chunks(docs), search.fixed_chunks(new))


@query("accessible_documents", "SELECT doc_id, source FROM documents WHERE source IN ('src0', 'src1') OR lang = 'de' OR doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def accessible_documents(spark, d):
    """Row-level access: global sources, owned language, or membership."""
    docs = table(spark, d, "documents")
    member = table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("_id"), F.lit(True).alias("member")).distinct()
    j = docs.join(member, docs["doc_id"] == member["_id"], "left")
    return j.where(F.col("source").isin("src0", "src1") | (F.col("lang") == "de") | F.col("member")).select("doc_id", "source")


@query("docs_unlabeled", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def docs_unlabeled(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id", "lang")


@query("orphan_labels", "SELECT doc_id, toxic FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE length(text) > 800)")
def orphan_labels(spark, d):
    alive = table(spark, d, "documents").where(F.char_length("text") > 800)
    return table(spark, d, "labels").join(alive, "doc_id", "left_anti").select("doc_id", "toxic")


@query("collections_search", "SELECT source, count(*) AS n_docs FROM documents WHERE source ILIKE '%RC1%' GROUP BY source")
def collections_search(spark, d):
    return table(spark, d, "documents").where(F.col("source").ilike("%RC1%")).groupBy("source").agg(F.count("*").alias("n_docs"))


@query("documents_topic_page", "SELECT doc_id, source FROM documents WHERE contains(lower(text), 'of the') ORDER BY doc_id LIMIT 20 OFFSET 10")
def documents_topic_page(spark, d):
    """Topic filter, then paging in key order."""
    return table(spark, d, "documents").where(F.lower("text").contains("of the")).select("doc_id", "source").orderBy("doc_id").offset(10).limit(20)


@query("source_doc_counts", "WITH s AS (SELECT DISTINCT source FROM documents), c AS (SELECT source, count(*) AS n FROM documents WHERE lang = 'fr' GROUP BY source) SELECT s.source, coalesce(n, 0) AS n_french FROM s LEFT JOIN c USING (source)")
def source_doc_counts(spark, d):
    docs = table(spark, d, "documents")
    n = docs.where("lang = 'fr'").groupBy("source").agg(F.count("*").alias("n"))
    return docs.select("source").distinct().join(n, "source", "left").select("source", F.coalesce("n", F.lit(0)).alias("n_french"))


@query("doc_facets", "SELECT source, lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY ROLLUP (source, lang)")
def doc_facets(spark, d):
    return table(spark, d, "documents").rollup("source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("language_census", """SELECT lang, count(*) AS n_docs, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS n_lines, CAST(sum(len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''))) AS BIGINT) AS n_code FROM documents GROUP BY lang""")
def language_census(spark, d):
    lines = F.split("text", "\n")
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum(F.size(lines)).alias("n_lines"), F.sum(F.size(F.filter(lines, lambda x: F.trim(x) != ""))).alias("n_code"))


@query("content_hash_dedupe", "SELECT sha256(text) AS hash, min(doc_id) AS doc_id, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1")
def content_hash_dedupe(spark, d):
    """DISTINCT ON content hash: the first document of each text."""
    return table(spark, d, "documents").where("text is not null").groupBy(F.sha2("text", 256).alias("hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


@query("embedding_reuse", """WITH h AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE text IS NOT NULL), k AS (SELECT h, min(vec_id) AS vec_id FROM h JOIN embeddings ON vec_id = doc_id WHERE doc_id % 2 = 0 GROUP BY h)
    SELECT doc_id, vec_id, vec_id IS NOT NULL AS hit FROM h LEFT JOIN k USING (h)""")  # fmt: skip
def embedding_reuse(spark, d):
    """Chunks whose content was embedded before reuse the vector; the rest are misses."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("chunk_hash"))
    known = docs.where("doc_id % 2 = 0").join(table(spark, d, "embeddings"), F.col("vec_id") == F.col("doc_id")).select("chunk_hash", "vec_id", "embedding")
    hit, miss = search.reuse_embeddings(docs, known)
    return hit.select("doc_id", "vec_id", F.lit(True).alias("hit")).union(docs.join(miss, "chunk_hash", "left_semi").select("doc_id", F.lit(None).cast("long"), F.lit(False)))


@query("chunk_skip_reasons", """WITH l AS (SELECT doc_id, text, list_transform(string_split(text, chr(10))[1:50], lambda x: length(x)) AS n FROM documents WHERE text IS NOT NULL),
    r AS (SELECT doc_id, CASE WHEN length(trim(text)) < 20 THEN 'too_short' WHEN list_max(n) >= 800 AND list_sum(n) * 1.0 / len(n) >= 250 THEN 'minified' WHEN contains(text, '|') THEN 'table' ELSE 'kept' END AS reason FROM l)
    SELECT reason, count(*) AS n FROM r GROUP BY reason""")  # fmt: skip
def chunk_skip_reasons(spark, d):
    """Low-signal chunk filter with a reason code, over the first 50 lines."""
    n = F.transform(F.slice(F.split("text", "\n"), 1, 50), F.char_length)
    total = F.aggregate("n", F.lit(0), lambda a, x: a + x)
    rows = table(spark, d, "documents").where("text is not null").select("text", n.alias("n"))
    reason = F.when(F.char_length(F.trim("text")) < 20, "too_short").when((F.array_max("n") >= 800) & (total / F.size("n") >= 250), "minified").when(F.col("text").contains("|"), "table").otherwise("kept")
    return rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("isolated_points", """WITH s AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    p AS (SELECT a.vec_id, min(1 - list_cosine_similarity(a.e, b.e)) AS dist FROM s a JOIN s b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY a.vec_id),
    t AS (SELECT avg(dist) + 1.2 * stddev_pop(dist) AS t FROM p)
    SELECT vec_id FROM p, t WHERE dist >= t""")  # fmt: skip
def isolated_points(spark, d):
    """Nearest-neighbour distance within the label block at or above mean + 1.2 population deviations."""
    near = materialize(vectorindex.nearest_distances(table(spark, d, "embeddings"), "vec_id", "embedding", "label"))
    limit = near.agg((F.avg("dist") + 1.2 * F.stddev_pop("dist")).alias("t"))
    return near.crossJoin(F.broadcast(limit)).where("dist >= t").select(F.col("id").alias("vec_id"))  # one row


@query("semantic_duplicates", """WITH s AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
    SELECT a.vec_id AS a, b.vec_id AS b FROM s a JOIN s b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.86""")  # fmt: skip
def semantic_duplicates(spark, d):
    """Pairs of one label block whose similarity is 0.86 or more, by the exact join over cells."""
    return vectorindex.similar_pairs(table(spark, d, "embeddings"), 0.86, 16, "vec_id", "embedding", "label")


@query("token_jaccard_pairs", """WITH b AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS t FROM benchmark)
    SELECT a.item_id AS a, c.item_id AS b FROM b a JOIN b c ON a.item_id < c.item_id WHERE len(list_intersect(a.t, c.t)) * 1.0 / len(list_distinct(list_concat(a.t, c.t))) >= 0.15""")  # fmt: skip
def token_jaccard_pairs(spark, d):
    """Pairs of items at 0.15 or more, counted from the tokens they share; items without one in common never meet."""
    b = table(spark, d, "benchmark").select("item_id", F.array_distinct(search.tokens(F.col("text"))).alias("t"))
    t = b.select(F.col("item_id").alias("a"), F.size("t").alias("m"), F.explode("t").alias("token"))
    u = t.withColumnsRenamed({"a": "b", "m": "n"})
    met = t.join(u, "token").where("a < b").groupBy("a", "b").agg(F.count("*").alias("both"), F.first("m").alias("m"), F.first("n").alias("n"))
    return met.where(F.col("both") / (F.col("m") + F.col("n") - F.col("both")) >= 0.15).select("a", "b")


@query("ordered_steps", "SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS roles, count(*) AS n FROM conversations GROUP BY conv_id")
def ordered_steps(spark, d):
    steps = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(steps, lambda x: x["role"]), ">").alias("roles"), F.count("*").alias("n"))


@query("eval_metrics", """SELECT lang, avg(CASE WHEN toxic = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS success_rate, count(CASE WHEN quality = 1 THEN 1 END) AS n_good, CAST(sum(n_chars) FILTER (quality = 1) AS BIGINT) AS good_chars FROM labels JOIN documents USING (doc_id) GROUP BY lang""")
def eval_metrics(spark, d):
    j = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    return j.groupBy("lang").agg(F.avg((F.col("toxic") == 0).cast("double")).alias("success_rate"), F.count_if(F.col("quality") == 1).alias("n_good"), F.sum(F.when(F.col("quality") == 1, F.col("n_chars"))).alias("good_chars"))


@query("rag_context", """WITH h AS (SELECT doc_id, source, text, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 5)
    SELECT string_agg('[' || rank || '] ' || source || chr(10) || substr(text, 1, 400), chr(10) || chr(10) ORDER BY rank) AS context, (SELECT string_agg(s, ',' ORDER BY s) FROM (SELECT DISTINCT source AS s FROM h)) AS sources FROM h""")  # fmt: skip
def rag_context(spark, d):
    docs = table(spark, d, "documents")
    hits = search.top_ranked(docs.select(F.col("doc_id").alias("id"), "n_chars"), 5, "rank", F.desc("n_chars"), F.col("id")).select("id", "rank")
    return search.context(hits, docs)


@query("entity_best_candidate", "SELECT label, vec_id, score FROM (SELECT label, vec_id, (vec_id * 37) % 101 AS score, row_number() OVER (PARTITION BY label ORDER BY (vec_id * 37) % 101 DESC, vec_id) AS r FROM embeddings) WHERE r = 1")
def entity_best_candidate(spark, d):
    """Best candidate per node by confidence, ties by key."""
    e = table(spark, d, "embeddings").select("label", "vec_id", (F.col("vec_id") * 37 % 101).alias("score"))
    return e.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("score"), "vec_id"))).where("r = 1").select("label", "vec_id", "score")


@query("community_seed_quota", """WITH e AS (SELECT label, vec_id, (vec_id * 37) % 101 AS score FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS k FROM e)
    SELECT label, vec_id FROM r ORDER BY CASE WHEN k <= 2 THEN 0 ELSE 1 END, score DESC, vec_id LIMIT 25""")  # fmt: skip
def community_seed_quota(spark, d):
    """Two members of each community first, then the overflow by score, to a limit of 25."""
    e = table(spark, d, "embeddings").select("label", "vec_id", (F.col("vec_id") * 37 % 101).alias("score"))
    e = e.withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("score"), "vec_id")))
    return e.orderBy(F.when(F.col("k") <= 2, 0).otherwise(1), F.desc("score"), "vec_id").limit(25).select("label", "vec_id")
