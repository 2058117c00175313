"""Full-text, vector and hybrid retrieval, chunking and context assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions.vectors import cosine

TOKEN = "[a-z]+"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def top_ranked(df: DataFrame, k: int, rank: str, *order: Column) -> DataFrame:
    """The first k rows (a bounded top-k) with their rank from 1."""
    return df.orderBy(*order).limit(k).withColumn(rank, F.row_number().over(Window.orderBy(*order)))


def full_text(docs: DataFrame, terms: list[str], k: int = 50) -> DataFrame:
    """id, fts_score, fts_rank of documents that hold all terms, by term frequency over length. Key last, so ranks are stable."""
    t = docs.select(F.col("doc_id").alias("id"), tokens(F.col("text")).alias("t"))
    for x in terms:
        t = t.where(F.array_contains("t", x))
    hits = F.size(F.filter("t", lambda x: x.isin(terms)))
    scored = t.select("id", (hits / F.size("t")).alias("fts_score"))
    return top_ranked(scored, k, "fts_rank", F.desc("fts_score"), F.col("id"))


def vector_search(vectors: DataFrame, query: DataFrame, k: int = 50) -> DataFrame:
    """id, vector_score, vector_rank of the rows nearest by cosine to the one row of query (q)."""
    scored = vectors.crossJoin(F.broadcast(query)).select(F.col("vec_id").alias("id"), cosine(F.col("embedding"), F.col("q")).alias("vector_score"))  # one query row
    return top_ranked(scored, k, "vector_rank", F.desc("vector_score"), F.col("id"))


def reciprocal_rank_fusion(fts: DataFrame, vec: DataFrame, k: int = 60) -> DataFrame:
    """Full outer merge of two ranked lists; score is the sum of 1 / (k + rank)."""
    part = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    return fts.join(vec, "id", "full_outer").withColumn("rrf_score", part("fts_rank") + part("vector_rank"))


def hybrid(docs: DataFrame, vectors: DataFrame, query: DataFrame, terms: list[str], top_k: int = 20, pool: int = 50, allowed: DataFrame | None = None) -> DataFrame:
    """id, rrf_score and both ranks of the best top_k; ties by full-text rank, vector rank, id.

    allowed (id): both searches rank these only, so what may not be seen takes no place in the pools.
    """
    if allowed is not None:
        ids = allowed.select("id").distinct()
        docs = docs.join(ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi")
        vectors = vectors.join(ids.withColumnRenamed("id", "vec_id"), "vec_id", "left_semi")
    fused = reciprocal_rank_fusion(full_text(docs, terms, pool), vector_search(vectors, query, pool))
    return fused.orderBy(F.desc("rrf_score"), F.col("fts_rank").asc_nulls_last(), F.col("vector_rank").asc_nulls_last(), "id").limit(top_k)


def mean_vectors(vectors: DataFrame, key: str, vec_col: str = "embedding") -> DataFrame:
    """key, n_members and embedding (the mean over members, place by place)."""
    cells = vectors.select(key, F.posexplode(vec_col).alias("i", "x"))
    means = cells.groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count("*").alias("n"))
    out = means.groupBy(key).agg(F.max("n").alias("n_members"), F.array_sort(F.collect_list(F.struct("i", "x"))).alias("m"))
    return out.select(key, "n_members", F.transform("m", lambda r: r["x"]).alias("embedding"))


def relevant_communities(communities: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """The k communities (with an embedding) most similar to the one row of query (q), with their relevance; ties by id. None is made up where there are none."""
    scored = communities.where("embedding is not null").crossJoin(F.broadcast(query)).withColumn("relevance", cosine(F.col("embedding"), F.col("q")))  # one query row
    return top_ranked(scored.drop("embedding", "q"), k, "rank", F.desc("relevance"), F.col("community"))


def search_nodes(hits: DataFrame, nodes: DataFrame, limit: int = 20) -> DataFrame:
    """File nodes (id, natural_key) that search hits (uri, rank) name: by the whole address or by its path below the host; the best ranks first."""
    path = F.regexp_replace(F.regexp_replace("uri", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*/", ""), r"[?#].*$", "")
    keys = hits.where("uri is not null").select("rank", F.explode(F.array_distinct(F.array(F.col("uri"), path))).alias("natural_key"))
    found = keys.join(nodes.select("id", "natural_key"), "natural_key").groupBy("id").agg(F.min("rank").alias("rank"))
    return found.orderBy("rank", "id").limit(limit)


def fixed_chunks(docs: DataFrame, size: int = 1500, overlap: int = 200) -> DataFrame:
    """doc_id, chunk_index, chunk, chunk_hash: windows of size characters that overlap."""
    step = size - overlap
    count = F.greatest(F.ceil((F.char_length("text") - overlap) / step), F.lit(1)).cast("int")
    rows = docs.where("text is not null").select("doc_id", "text", F.explode(F.sequence(F.lit(0), count - 1)).alias("chunk_index"))
    chunk = F.substring(F.col("text"), F.col("chunk_index") * step + 1, F.lit(size))
    return rows.select("doc_id", "chunk_index", chunk.alias("chunk")).withColumn("chunk_hash", F.sha2("chunk", 256))


def chunk_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Content-hash maintenance: (doc_id, chunk_hash, status) with status add, delete or keep, in one full outer join."""
    a = old.select("doc_id", "chunk_hash").distinct().withColumn("o", F.lit(1))
    b = new.select("doc_id", "chunk_hash").distinct().withColumn("n", F.lit(1))
    status = F.when(F.col("o").isNull(), "add").when(F.col("n").isNull(), "delete").otherwise("keep")
    return a.join(b, ["doc_id", "chunk_hash"], "full_outer").select("doc_id", "chunk_hash", status.alias("status"))


def reuse_embeddings(chunks: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks whose content hash has an embedding already (the least vec_id), and the distinct hashes that miss one."""
    first = known.groupBy("chunk_hash").agg(F.min_by("embedding", "vec_id").alias("embedding"), F.min("vec_id").alias("vec_id"))
    return chunks.join(first, "chunk_hash"), chunks.select("chunk_hash").distinct().join(first, "chunk_hash", "left_anti")


def context(hits: DataFrame, docs: DataFrame, max_chars: int = 400) -> DataFrame:
    """One row with the prompt context: numbered snippets in rank order and the distinct sources."""
    rows = hits.join(docs, hits["id"] == docs["doc_id"]).select("rank", "source", F.substring("text", 1, max_chars).alias("snippet"))
    block = F.concat(F.lit("["), F.col("rank"), F.lit("] "), F.col("source"), F.lit("\n"), F.col("snippet"))
    agg = rows.agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))).alias("x"), F.array_sort(F.collect_set("source")).alias("sources"))
    return agg.select(F.array_join(F.transform("x", lambda r: r["b"]), "\n\n").alias("context"), F.array_join("sources", ",").alias("sources"))
