"""Named queries of graph loading, scope filters, citations, pages, titles, schema merges and roll-ups by folder."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.plans.frames import FILES, KINDS, PART_EDGES, files, kinds, part_edges
from quarry.plans.graph import DEG
from quarry.plans.registry import query
from quarry.sources.tables import table


def _nodes(spark, d):
    return kinds(table(spark, d, "part"))


@query("graph_from_json", "SELECT l_orderkey AS src, l_partkey AS dst, l_linenumber AS weight FROM lineitem")
def graph_from_json(spark, d):
    """Graphs written as one JSON document an order, loaded again by a declared schema."""
    edge = F.struct(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_linenumber").alias("weight"))
    docs = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.struct(F.collect_list(edge).alias("edges"))).alias("json"))
    loaded = docs.select(F.from_json("json", "edges array<struct<src: bigint, dst: bigint, weight: int>>").alias("g"))
    return loaded.select(F.inline("g.edges"))


@query("export_cx2", f"""WITH {PART_EDGES}, n AS ({KINDS}) SELECT '{{"id":' || id || ',"v":{{"name":"' || name || '","kind":"' || kind || '"}}}}' AS line, 'nodes' AS aspect FROM n UNION ALL SELECT '{{"s":' || src || ',"t":' || dst || '}}', 'edges' FROM edges""")
def export_cx2(spark, d):
    """The elements of the nodes and edges aspects as JSON, a row each."""
    n = _nodes(spark, d).select(F.to_json(F.struct("id", F.struct("name", "kind").alias("v"))).alias("line"), F.lit("nodes").alias("aspect"))
    return n.union(part_edges(spark, d).select(F.to_json(F.struct(F.col("src").alias("s"), F.col("dst").alias("t"))), F.lit("edges")))


@query("folder_tree_metrics", f"WITH f AS ({FILES}) SELECT coalesce(container, 'root') AS folder, component, CAST(sum(loc) AS BIGINT) AS rloc, CAST(sum(loc * complexity) AS DOUBLE) / sum(loc) AS complexity, count(*) AS n FROM f GROUP BY GROUPING SETS ((), (container), (container, component))")
def folder_tree_metrics(spark, d):
    """Every level of the folder tree: lines, line-weighted complexity and files."""
    f = files(spark, d)
    sets = f.groupingSets([[], [F.col("container")], [F.col("container"), F.col("component")]], F.col("container"), F.col("component"))
    g = sets.agg(F.sum("loc").alias("rloc"), (F.sum(F.col("loc") * F.col("complexity")).cast("double") / F.sum("loc")).alias("complexity"), F.count("*").alias("n"))
    return g.select(F.coalesce("container", F.lit("root")).alias("folder"), "component", "rloc", "complexity", "n")


@query("taint_sources", f"WITH n AS ({KINDS}) SELECT id, name, word FROM n JOIN (VALUES ('function', 'a'), ('function', 'e'), ('method', 'o'), ('method', 'i')) r(kind, word) USING (kind) WHERE starts_with(lower(name), word) OR ends_with(lower(name), word)")
def taint_sources(spark, d):
    """Nodes that a table of source patterns (by kind) names; the rules are four rows and broadcast."""
    rules = spark.createDataFrame([("function", "a"), ("function", "e"), ("method", "o"), ("method", "i")], "kind string, word string")
    n = _nodes(spark, d).join(F.broadcast(rules), "kind")
    name = F.lower("name")
    return n.where(F.startswith(name, F.col("word")) | F.endswith(name, F.col("word"))).select("id", "name", "word")


@query("node_layers", f"WITH n AS ({KINDS}) SELECT id, CASE kind WHEN 'class' THEN 'domain_model' WHEN 'module' THEN 'component_interface' WHEN 'variable' THEN 'data' ELSE 'code_controlflow' END AS layer FROM n")
def node_layers(spark, d):
    """The architecture layer of a node by a rule table on its kind."""
    k = F.col("kind")
    layer = F.when(k == "class", "domain_model").when(k == "module", "component_interface").when(k == "variable", "data").otherwise("code_controlflow")
    return _nodes(spark, d).select("id", layer.alias("layer"))


def scoped(nodes, edges, scope):
    """Nodes whose brand or type is the scope, all if none is, and the edges among them."""
    hit = nodes.where((F.col("p_brand") == scope) | (F.col("p_type") == scope)).select("id")
    none = hit.agg((F.count("*") == 0).alias("none"))  # one row
    kept = hit.union(nodes.select("id").join(F.broadcast(none), F.col("none")).select("id"))
    a, b = kept.withColumnRenamed("id", "src"), kept.withColumnRenamed("id", "dst")
    return edges.join(a, "src", "left_semi").join(b, "dst", "left_semi")


@query("scope_filter", f"""WITH {PART_EDGES}, n AS (SELECT p_partkey AS id, p_brand, p_type FROM part), b AS (SELECT min(p_brand) AS scope FROM part), k AS (SELECT id FROM n, b WHERE p_brand = scope OR p_type = scope)
    SELECT 'brand' AS scope, src, dst FROM edges WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k) UNION ALL SELECT 'none', src, dst FROM edges""")  # fmt: skip
def scope_filter(spark, d):
    """A scope that matches keeps its induced subgraph; one that matches nothing keeps all."""
    n = table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_brand", "p_type")
    e = part_edges(spark, d)
    first = n.agg(F.min("p_brand").alias("scope"))
    brand = scoped(n.join(F.broadcast(first), F.col("p_brand") == F.col("scope"), "left").withColumn("p_brand", F.when(F.col("scope").isNotNull(), "wanted")), e, "wanted")
    return brand.select(F.lit("brand").alias("scope"), "src", "dst").union(scoped(n, e, "no such scope").select(F.lit("none"), "src", "dst"))


@query("payload_filter", f"WITH {PART_EDGES}, n AS ({KINDS}), k AS (SELECT id FROM n WHERE kind <> 'variable' AND parent IS NOT NULL) SELECT src, dst FROM edges WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)")
def payload_filter(spark, d):
    """A graph payload filtered by kind and provenance, with the edges that stay."""
    k = _nodes(spark, d).where("kind <> 'variable' and parent is not null").select("id")
    return part_edges(spark, d).join(k.withColumnRenamed("id", "src"), "src", "left_semi").join(k.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")


@query("semantic_chunk_budget", """SELECT doc_id, kind, rank FROM (SELECT doc_id, kind, CAST(row_number() OVER (ORDER BY CASE kind WHEN 'code' THEN 0 WHEN 'prose' THEN 1 ELSE 2 END, n_chars DESC, doc_id) AS INTEGER) AS rank
    FROM (SELECT doc_id, n_chars, CASE WHEN contains(text, '{') THEN 'code' WHEN n_chars >= 400 THEN 'prose' ELSE 'other' END AS kind FROM documents WHERE text IS NOT NULL)) WHERE rank <= 80""")  # fmt: skip
def semantic_chunk_budget(spark, d):
    """Chunks by kind and a stable priority; the budget is the operator's own limit of 80."""
    kind = F.when(F.col("text").contains("{"), "code").when(F.col("n_chars") >= 400, "prose").otherwise("other")
    c = table(spark, d, "documents").where("text is not null").select("doc_id", "n_chars", kind.alias("kind"))
    first = F.when(F.col("kind") == "code", 0).when(F.col("kind") == "prose", 1).otherwise(2)
    top = c.withColumn("first", first).orderBy("first", F.desc("n_chars"), "doc_id").limit(80)
    return top.withColumn("rank", F.row_number().over(Window.orderBy("first", F.desc("n_chars"), "doc_id"))).select("doc_id", "kind", "rank")


@query("citations", "SELECT DISTINCT l_partkey AS file, l_linenumber AS first_line, l_linenumber + CAST(l_quantity AS BIGINT) AS last_line FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0 ORDER BY file, first_line, last_line LIMIT 50")
def citations(spark, d):
    """Evidence of nodes over a bridge table, distinct by file and lines; the cap of 50 is the operator's own."""
    good = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    bridge = table(spark, d, "orders").join(good, "o_custkey", "left_semi").select(F.col("o_orderkey").alias("l_orderkey"))
    e = table(spark, d, "lineitem").join(bridge, "l_orderkey", "left_semi")
    e = e.select(F.col("l_partkey").alias("file"), F.col("l_linenumber").alias("first_line"), (F.col("l_linenumber") + F.col("l_quantity").cast("long")).alias("last_line"))
    return e.distinct().orderBy("file", "first_line", "last_line").limit(50)


@query("scoped_cleanup", "SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def scoped_cleanup(spark, d):
    """Nodes left after those tied to the target evidence are deleted."""
    tied = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("id"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id")).join(tied, "id", "left_anti")


@query("evidence_view", "SELECT item_id, coalesce(CASE WHEN item_id % 2 = 0 THEN 'snippet ' || item_id END, string_split(text, chr(10))[1]) AS shown FROM benchmark")
def evidence_view(spark, d):
    """The snippet of a piece of evidence, else the first line of its document."""
    snippet = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("snippet "), F.col("item_id").cast("string")))
    return table(spark, d, "benchmark").select("item_id", F.coalesce(snippet, F.split("text", "\n")[0]).alias("shown"))


@query("schema_merge", "SELECT p_brand AS tbl, p_type AS col, min(p_size) AS size, count(*) AS defs, count(DISTINCT p_partkey % 5) AS keys FROM part GROUP BY p_brand, p_type")
def schema_merge(spark, d):
    """Column definitions merged by table and name, with distinct foreign-key signatures."""
    p = table(spark, d, "part").groupBy(F.col("p_brand").alias("tbl"), F.col("p_type").alias("col"))
    return p.agg(F.min("p_size").alias("size"), F.count("*").alias("defs"), F.count_distinct(F.col("p_partkey") % 5).alias("keys"))


@query("callgraph_page", f"WITH {PART_EDGES}, {DEG}, p AS (SELECT id, degree FROM deg ORDER BY degree DESC, id LIMIT 50 OFFSET 50) SELECT id, degree, (SELECT count(*) FROM edges WHERE src = p.id AND dst IN (SELECT id FROM p)) AS inside FROM p")
def callgraph_page(spark, d):
    """The second page of 50 connected nodes by degree, with the calls each makes inside the page."""
    e = part_edges(spark, d)
    deg = e.select(F.col("src").alias("id")).union(e.select("dst")).groupBy("id").agg(F.count("*").alias("degree"))
    p = deg.orderBy(F.desc("degree"), "id").offset(50).limit(50)
    ids = p.select("id")
    inside = e.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("inside"))
    return p.join(inside, "id", "left").na.fill(0, ["inside"])


@query("community_titles", """WITH r AS (SELECT p_brand, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS k, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
    SELECT p_brand AS community, string_agg(p_name, ', ' ORDER BY k) || CASE WHEN max(n) > 3 THEN ' +' || (max(n) - 3) || ' more' ELSE '' END AS title FROM r WHERE k <= 3 GROUP BY p_brand""")  # fmt: skip
def community_titles(spark, d):
    """Titles from a community's three top members and the number of others; the window keeps three rows a task before its shuffle."""
    p = table(spark, d, "part")
    top = p.withColumn("k", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey"))).where("k <= 3")
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "p_name"))), lambda x: x["p_name"]), ", ")
    t = top.groupBy("p_brand").agg(names.alias("names")).join(p.groupBy("p_brand").agg(F.count("*").alias("n")), "p_brand")
    more = F.when(F.col("n") > 3, F.concat(F.lit(" +"), (F.col("n") - 3).cast("string"), F.lit(" more"))).otherwise("")
    return t.select(F.col("p_brand").alias("community"), F.concat("names", more).alias("title"))


@query("due_sources", "SELECT o_custkey AS source FROM orders GROUP BY o_custkey HAVING max(o_orderdate) + INTERVAL 90 DAY <= (SELECT max(o_orderdate) FROM orders)")
def due_sources(spark, d):
    """Sources whose next run, 90 days after their last, is due."""
    o = table(spark, d, "orders")
    now = o.agg(F.max("o_orderdate").alias("now"))  # one row
    last = o.groupBy(F.col("o_custkey").alias("source")).agg((F.max("o_orderdate") + F.expr("interval 90 days")).alias("next"))
    return last.join(F.broadcast(now), F.col("next") <= F.col("now")).select("source")


@query("metric_snapshot_refresh", f"WITH f AS ({FILES}) SELECT file, loc, complexity, coverage FROM f WHERE loc > 0 AND complexity > 0 AND coverage IS NOT NULL")
def metric_snapshot_refresh(spark, d):
    """The snapshot built again from files that have all their metrics."""
    return files(spark, d).where("loc > 0 and complexity > 0 and coverage is not null").select("file", "loc", "complexity", "coverage")


@query("order_ranks", "SELECT o_orderkey, CAST(rank() OVER w AS INTEGER) AS rank, CAST(ntile(4) OVER w AS INTEGER) AS quarter, lag(o_orderkey) OVER w AS before FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)")
def order_ranks(spark, d):
    """Rank, quartile and predecessor within a customer."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.rank().over(w).alias("rank"), F.ntile(4).over(w).alias("quarter"), F.lag("o_orderkey").over(w).alias("before"))


@query("flag_cube", "SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def flag_cube(spark, d):
    """Counts over every combination of two attributes."""
    return table(spark, d, "lineitem").cube(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status")).agg(F.count("*").alias("n"))
