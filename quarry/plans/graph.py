"""Named queries of graph traversal, projections, paging and roll-ups over the part graph."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.operators import graphs, ingest, iterate
from quarry.plans.frames import KINDS, PART_EDGES, kinds, part_edges
from quarry.plans.registry import query
from quarry.session import shared_dir
from quarry.sources import symbolindex
from quarry.sources.tables import table


def _nodes(spark, d):
    return kinds(table(spark, d, "part"))


@query("graph_neighbors", f"WITH {PART_EDGES} SELECT src AS id, dst AS neighbor, 'out' AS direction FROM edges UNION SELECT dst, src, 'in' FROM edges")
def graph_neighbors(spark, d):
    return iterate.neighbors(part_edges(spark, d), _nodes(spark, d).select("id"))


UND = "und AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges)"


@query("bfs_depth2", f"""WITH {PART_EDGES}, {UND}, l1 AS (SELECT DISTINCT dst AS id FROM und WHERE src IN (1, 2) AND dst NOT IN (1, 2)), l2 AS (SELECT DISTINCT dst AS id FROM und WHERE src IN (SELECT id FROM l1) AND dst NOT IN (1, 2) AND dst NOT IN (SELECT id FROM l1))
    SELECT 1 AS id, 0 AS level UNION ALL SELECT 2, 0 UNION ALL SELECT id, 1 FROM l1 UNION ALL SELECT id, 2 FROM l2""")  # fmt: skip
def bfs_depth2(spark, d):
    seeds = _nodes(spark, d).where("id in (1, 2)").select("id")
    return iterate.bfs(iterate.undirected(part_edges(spark, d)), seeds, 2)


@query("expand_neighborhood", f"""WITH {PART_EDGES}, {UND}, l1 AS (SELECT DISTINCT dst AS id FROM und WHERE src = 3 AND dst <> 3), l2 AS (SELECT DISTINCT dst AS id FROM und WHERE src IN (SELECT id FROM l1) AND dst <> 3 AND dst NOT IN (SELECT id FROM l1)),
    a AS (SELECT 3 AS id, 0 AS level UNION ALL SELECT id, 1 FROM l1 UNION ALL SELECT id, 2 FROM l2) SELECT id, level, 1.0::DOUBLE - 0.2::DOUBLE * level AS relevance FROM a ORDER BY level, id LIMIT 20""")  # fmt: skip
def expand_neighborhood(spark, d):
    """Level expansion with a node limit of 20; relevance falls by 0.2 a level."""
    return iterate.expand(iterate.undirected(part_edges(spark, d)), _nodes(spark, d).where("id = 3").select("id"), 2, 20)


@query("shortest_path", f"""WITH RECURSIVE {PART_EDGES}, p(id, path) AS (SELECT CAST(1 AS BIGINT), [CAST(1 AS BIGINT)] UNION ALL SELECT dst, list_append(path, dst) FROM p JOIN edges ON src = id WHERE len(path) <= 3 AND NOT list_contains(path, dst)),
    h AS (SELECT len(path) - 1 AS hops, path FROM p WHERE id = 40) SELECT CAST(min(hops) AS INTEGER) AS hops FROM h HAVING min(hops) IS NOT NULL""")  # fmt: skip
def shortest_path(spark, d):
    return iterate.shortest_path(part_edges(spark, d), 1, 40, 3).select("hops")


@query("shortest_path_edges", f"""WITH {PART_EDGES}, f1 AS (SELECT DISTINCT dst AS id FROM edges WHERE src = 1), f2 AS (SELECT DISTINCT dst AS id FROM edges WHERE src IN (SELECT id FROM f1) AND dst <> 1 AND dst NOT IN (SELECT id FROM f1)),
    b1 AS (SELECT DISTINCT src AS id FROM edges WHERE dst = 40), b2 AS (SELECT DISTINCT src AS id FROM edges WHERE dst IN (SELECT id FROM b1)),
    k AS (SELECT CASE WHEN EXISTS (SELECT 1 FROM b1 WHERE id = 1) THEN 1 WHEN EXISTS (SELECT 1 FROM b1 WHERE id IN (SELECT id FROM f1)) THEN 2 WHEN EXISTS (SELECT 1 FROM b1 WHERE id IN (SELECT id FROM f2)) THEN 3 END AS hops)
    SELECT 0 AS hop, src, dst FROM edges, k WHERE src = 1 AND (hops = 1 AND dst = 40 OR hops = 2 AND dst IN (SELECT id FROM b1) OR hops = 3 AND dst IN (SELECT id FROM b2))
    UNION SELECT 1, src, dst FROM edges, k WHERE src IN (SELECT id FROM f1) AND (hops = 2 AND dst = 40 OR hops = 3 AND dst IN (SELECT id FROM b1) AND dst IN (SELECT id FROM f2))
    UNION SELECT 2, src, dst FROM edges, k WHERE hops = 3 AND src IN (SELECT id FROM f2) AND dst = 40""")  # fmt: skip
def shortest_path_edges(spark, d):
    """All edges on the shortest paths from part 1 to part 40, three hops at most."""
    edges = part_edges(spark, d)
    found = iterate.shortest_dag(edges, 1, 40, 3)
    return found[1] if found else edges.select(F.lit(0).alias("hop"), "src", "dst").limit(0)


@query("connected_components", f"""WITH RECURSIVE {PART_EDGES}, u AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), r(id, to_) AS (SELECT src, src FROM u UNION SELECT r.id, u.dst FROM r JOIN u ON u.src = r.to_)
    SELECT id, min(to_) AS component FROM r GROUP BY id""")  # fmt: skip
def connected_components(spark, d):
    return iterate.connected_components(part_edges(spark, d))


@query("scc_components", f"""WITH RECURSIVE {PART_EDGES}, r(a, b) AS (SELECT src, dst FROM edges UNION SELECT r.a, edges.dst FROM r JOIN edges ON edges.src = r.b),
    m AS (SELECT x.a AS id, max(greatest(x.a, x.b)) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.a) SELECT id, component FROM m""")  # fmt: skip
def scc_components(spark, d):
    """Cycles of more than one node; self-loops are none."""
    return iterate.strongly_connected(part_edges(spark, d))


@query("taint_paths", f"""WITH RECURSIVE {PART_EDGES}, u AS (SELECT src, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS r FROM edges WHERE dst % 7 <> 0) WHERE r <= 20),
    p(source, at_, path, sink) AS (SELECT p_partkey, p_partkey, [p_partkey], false FROM part WHERE p_partkey % 50 = 1 UNION ALL SELECT source, dst, list_append(path, dst), dst % 20 = 3 FROM p JOIN u ON u.src = p.at_ WHERE NOT sink AND len(path) <= 2 AND NOT list_contains(path, dst))
    SELECT source, at_ AS sink, array_to_string(path, '>') AS path, CAST(len(path) - 1 AS INTEGER) AS hops, 'high' AS confidence FROM p WHERE sink""")  # fmt: skip
def taint_paths(spark, d):
    """Source-to-sink simple paths that avoid sanitizers (keys divisible by 7)."""
    ids = _nodes(spark, d).select("id")
    p = iterate.simple_paths(part_edges(spark, d), ids.where("id % 50 = 1"), ids.where("id % 20 = 3"), ids.where("id % 7 = 0"), max_hops=2, fan_out=20)
    return p.withColumn("path", F.array_join(F.col("path").cast("array<string>"), ">"))


@query("communities_modularity")
def communities_modularity(spark, d):
    """Modularity communities of the undirected part graph; iterative, so tested by properties."""
    e = part_edges(spark, d).withColumn("w", F.lit(1.0))
    return iterate.louvain_pass(e, rounds=4)


DEG = "deg AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id)"


@query("degree_topn_subgraph", f"WITH {PART_EDGES}, {DEG}, top AS (SELECT id FROM deg ORDER BY degree DESC, id DESC LIMIT 60) SELECT src, dst FROM edges WHERE src IN (SELECT id FROM top) AND dst IN (SELECT id FROM top)")
def degree_topn_subgraph(spark, d):
    return graphs.top_degree_subgraph(part_edges(spark, d), 60).select("src", "dst")


@query("node_degrees", f"WITH {PART_EDGES} SELECT id, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree, count(*) AS degree FROM (SELECT src AS id, 0 AS i, 1 AS o FROM edges UNION ALL SELECT dst, 1, 0 FROM edges) GROUP BY id")
def node_degrees(spark, d):
    return graphs.degrees(part_edges(spark, d))


@query("edge_rollup_by_brand", f"WITH {PART_EDGES} SELECT a.p_brand AS a, b.p_brand AS b, count(*) AS weight FROM edges JOIN part a ON a.p_partkey = src JOIN part b ON b.p_partkey = dst WHERE a.p_brand <> b.p_brand GROUP BY a.p_brand, b.p_brand")
def edge_rollup_by_brand(spark, d):
    m = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("entity"))
    return graphs.lift(part_edges(spark, d), m)


@query("architecture_projection", "SELECT p_brand AS container, CASE WHEN grouping(p_type) = 0 THEN p_type END AS component, count(*) AS members, CAST(sum(p_size) AS BIGINT) AS loc, string_agg(DISTINCT CAST(p_size % 3 AS VARCHAR), ',' ORDER BY CAST(p_size % 3 AS VARCHAR)) AS provenance FROM part GROUP BY ROLLUP (p_brand, p_type)")
def architecture_projection(spark, d):
    """Members rolled up to component, container and all, with the provenance mix."""
    p = table(spark, d, "part").withColumn("prov", (F.col("p_size") % 3).cast("string"))
    return p.rollup(F.col("p_brand").alias("container"), F.col("p_type").alias("component")).agg(F.count("*").alias("members"), F.sum("p_size").alias("loc"), F.array_join(F.array_sort(F.collect_set("prov")), ",").alias("provenance"))


@query("subgraph_by_kind", f"""WITH {PART_EDGES}, n AS ({KINDS}) SELECT src, dst FROM edges JOIN n a ON a.id = src JOIN n b ON b.id = dst WHERE (a.kind = 'class' AND b.kind IN ('class', 'method')) OR (b.kind = 'class' AND a.kind IN ('class', 'method'))""")
def subgraph_by_kind(spark, d):
    return graphs.subgraph_by_kind(_nodes(spark, d), part_edges(spark, d), ["class"], ["method"])


@query("code_symbol_projection", f"WITH {PART_EDGES}, n AS ({KINDS}) SELECT src, dst FROM edges WHERE src IN (SELECT id FROM n WHERE kind NOT IN ('module', 'variable')) AND dst IN (SELECT id FROM n WHERE kind NOT IN ('module', 'variable'))")
def code_symbol_projection(spark, d):
    """Kinds excluded, then the induced edges."""
    keep = _nodes(spark, d).where(~F.col("kind").isin("module", "variable"))
    return graphs.induced(part_edges(spark, d), keep).select("src", "dst")


@query("symbol_importance", f"""WITH {PART_EDGES}, n AS ({KINDS}), g AS (SELECT id, sum(i) AS i, sum(o) AS o FROM (SELECT src AS id, 0 AS i, 1 AS o FROM edges UNION ALL SELECT dst, 1, 0 FROM edges) GROUP BY id)
    SELECT id, CAST(2 * coalesce(i, 0) + coalesce(o, 0) + CASE kind WHEN 'class' THEN 5 WHEN 'function' THEN 3 WHEN 'method' THEN 2 WHEN 'module' THEN 1 ELSE 0.5 END + CASE WHEN parent IS NULL THEN 2 ELSE 0 END + CASE WHEN lines > 20 THEN 1 ELSE 0 END + CASE WHEN lines > 50 THEN 1 ELSE 0 END AS DOUBLE) AS score FROM n LEFT JOIN g USING (id) ORDER BY score DESC, id LIMIT 50""")  # fmt: skip
def symbol_importance(spark, d):
    weights = {"class": 5.0, "function": 3.0, "method": 2.0, "module": 1.0, "variable": 0.5}
    return graphs.importance(_nodes(spark, d), part_edges(spark, d), weights).orderBy(F.desc("score"), "id").limit(50)


@query("graph_page_cut", f"""WITH {PART_EDGES}, n AS ({KINDS}), p AS (SELECT id FROM n ORDER BY kind, name, id LIMIT 100 OFFSET 100) SELECT count(CASE WHEN s AND t THEN 1 END) AS inside, count(CASE WHEN s <> t THEN 1 END) AS crossing FROM (SELECT src IN (SELECT id FROM p) AS s, dst IN (SELECT id FROM p) AS t FROM edges)""")
def graph_page_cut(spark, d):
    """The second page of 100 nodes: edges inside it and edges cut by its border."""
    p = graphs.page(_nodes(spark, d), [F.col("kind"), F.col("name"), F.col("id")], 1, 100).select("id")
    return graphs.cut_edges(part_edges(spark, d), p)


@query("method_list_page", f"WITH n AS ({KINDS}) SELECT id, name FROM n WHERE kind IN ('function', 'method') AND name ILIKE '%a%' ORDER BY name, id LIMIT 50")
def method_list_page(spark, d):
    return _nodes(spark, d).where(F.col("kind").isin("function", "method") & F.col("name").ilike("%a%")).orderBy("name", "id").limit(50).select("id", "name")


@query("call_list", f"WITH {PART_EDGES} SELECT src, dst, coalesce(a.p_name, CAST(src AS VARCHAR)) AS caller, coalesce(b.p_name, CAST(dst AS VARCHAR)) AS callee FROM edges LEFT JOIN (SELECT * FROM part WHERE p_partkey % 9 <> 0) a ON a.p_partkey = src LEFT JOIN part b ON b.p_partkey = dst")
def call_list(spark, d):
    """Edges with the names of both ends; an unknown end shows its id."""
    p = table(spark, d, "part")
    a = p.where("p_partkey % 9 <> 0").select(F.col("p_partkey").alias("src"), F.col("p_name").alias("an"))
    b = p.select(F.col("p_partkey").alias("dst"), F.col("p_name").alias("bn"))
    e = part_edges(spark, d).join(a, "src", "left").join(b, "dst", "left")
    return e.select("src", "dst", F.coalesce("an", F.col("src").cast("string")).alias("caller"), F.coalesce("bn", F.col("dst").cast("string")).alias("callee"))


@query("graph_merge", "SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'new' ELSE 'old' END AS side, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS name FROM part WHERE p_partkey % 3 <> 0 OR p_partkey % 2 = 0")
def graph_merge(spark, d):
    """Union of two graphs' nodes: the newer row of a key wins."""
    p = table(spark, d, "part")
    old = p.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("id"), F.lit("old").alias("side"), F.col("p_name").alias("name"))
    new = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), F.lit("new").alias("side"), F.upper("p_name").alias("name"))
    return graphs.merge_nodes(old, new, "id")


@query("scenario_clone", f"WITH {PART_EDGES} SELECT 'c' || src AS src, 'c' || dst AS dst FROM edges")
def scenario_clone(spark, d):
    """Copy of a graph with remapped ids, by joins on the id map."""
    ids = _nodes(spark, d).select("id", F.concat(F.lit("c"), F.col("id").cast("string")).alias("new"))
    e = part_edges(spark, d).join(ids.withColumnsRenamed({"id": "src", "new": "s"}), "src").join(ids.withColumnsRenamed({"id": "dst", "new": "t"}), "dst")
    return e.select(F.col("s").alias("src"), F.col("t").alias("dst"))


SYMBOL_LINES = "SELECT l_orderkey, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem"


def order_indexes(spark, d):
    """path and content: an order as a binary symbol index."""
    table(spark, d, "lineitem").createOrReplaceTempView("lineitem_symbols")
    lines = spark.sql(SYMBOL_LINES.replace("FROM lineitem", "FROM lineitem_symbols"))
    files = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("n", "l_partkey", "l_suppkey"))).alias("own"))

    @F.pandas_udf("binary")
    def index(keys: pd.Series, own: pd.Series) -> pd.Series:
        one = lambda k, rows: symbolindex.write_document(f"o{k}.py", [(f"shop py shop 1 p{r['l_partkey']}n{r['n']}().", 10 * r["n"], 5) for r in rows], [(f"shop py shop 1 s{r['l_suppkey']}#", 10 * r["n"] + 2, 8) for r in rows])
        return pd.Series([one(k, rows) for k, rows in zip(keys, own, strict=True)])

    return files.select(F.concat(F.lit("o"), "l_orderkey").alias("path"), index("l_orderkey", "own").alias("content"))


@query("symbol_index_relations", f"""WITH l AS ({SYMBOL_LINES})
    SELECT DISTINCT 'o' || l_orderkey AS path, 'shop py shop 1 p' || l_partkey || 'n' || n || '().' AS source, 'calls' AS kind, 'shop py shop 1 s' || l_suppkey || '#' AS target FROM l""")  # fmt: skip
def symbol_index_relations(spark, d):
    """An order as a binary symbol index (a function a line that uses its supplier), decoded into relations."""
    return symbolindex.relations(symbolindex.decode(order_indexes(spark, d), needed=True))


@query("snapshot_ingest", f"""WITH l AS ({SYMBOL_LINES}), p AS (SELECT 'file:o' || l_orderkey || '.py' AS f, 'symbol:shop py shop 1 p' || l_partkey || 'n' || n || '().' AS s, 'symbol:shop py shop 1 s' || l_suppkey || '#' AS t FROM l)
    SELECT DISTINCT f AS src, s AS dst, 'file_defines_symbol' AS kind FROM p UNION SELECT s, t, 'symbol_calls_symbol' FROM p""")  # fmt: skip
def snapshot_ingest(spark, d):
    """The edges of the graph that all orders' indexes give, published as a version of a scenario."""
    path = f"{shared_dir(spark)}/graph-{uuid.uuid4().hex}"
    ingest.ingest(spark, symbolindex.decode(order_indexes(spark, d), needed=True), path, "as is", 0)
    return ingest.latest(spark, path, "edges", ingest.EDGE).select("src", "dst", "kind")


@query("range_containment_join", """WITH r AS (SELECT l_orderkey AS range_id, l_partkey AS file, epoch(l_shipdate) // 86400 AS lo, epoch(l_shipdate) // 86400 + l_quantity AS hi FROM lineitem WHERE l_linenumber = 1), p AS (SELECT l_orderkey * 10 + l_linenumber AS point, l_partkey AS file, epoch(l_shipdate) // 86400 AS pt FROM lineitem WHERE l_linenumber = 2)
    SELECT point, range_id FROM (SELECT point, range_id, row_number() OVER (PARTITION BY point ORDER BY hi - lo, range_id) AS k FROM p JOIN r USING (file) WHERE pt BETWEEN lo AND hi) WHERE k = 1""")  # fmt: skip
def range_containment_join(spark, d):
    """Narrowest enclosing range of the same file for each point."""
    l = table(spark, d, "lineitem")  # noqa: E741
    day = F.unix_date(F.to_date("l_shipdate")).cast("double")
    r = l.where("l_linenumber = 1").select(F.col("l_orderkey").alias("range_id"), F.col("l_partkey").alias("file"), day.alias("lo"), (day + F.col("l_quantity")).alias("hi"))
    p = l.where("l_linenumber = 2").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("point"), F.col("l_partkey").alias("file"), day.alias("at"))
    return graphs.enclosing(p, r)


@query("cooccurrence_strength", f"""WITH o AS (SELECT DISTINCT l_orderkey AS doc, p_type || p_size % 10 AS e FROM lineitem JOIN part ON p_partkey = l_partkey), c AS (SELECT a.e AS a, b.e AS b, count(*) AS n FROM o a JOIN o b ON a.doc = b.doc AND a.e < b.e GROUP BY a.e, b.e)
    SELECT a, b, n, CASE WHEN n >= 5 THEN 0.8 WHEN n >= 3 THEN 0.6 WHEN n = 2 THEN 0.5 ELSE 0.3 END AS strength FROM c WHERE NOT (a LIKE 'A%' AND b LIKE 'B%')""")  # fmt: skip
def cooccurrence_strength(spark, d):
    """Entities that meet in a document, known pairs left out, strength in bands."""
    e = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    o = e.select(F.col("l_orderkey").alias("doc"), F.concat("p_type", (F.col("p_size") % 10).cast("string")).alias("a")).distinct()
    n = o.join(o.withColumnRenamed("a", "b"), "doc").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))
    known = n.where("a like 'A%' and b like 'B%'").select("a", "b")
    band = F.when(F.col("n") >= 5, 0.8).when(F.col("n") >= 3, 0.6).when(F.col("n") == 2, 0.5).otherwise(0.3)
    return n.join(known, ["a", "b"], "left_anti").select("a", "b", "n", band.cast("decimal(2,1)").alias("strength"))


@query("entity_merge", "SELECT p_brand AS name, mode_type AS type, longest, aliases FROM (SELECT p_brand, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS aliases FROM part GROUP BY p_brand) JOIN (SELECT p_brand, p_type AS mode_type FROM (SELECT p_brand, p_type, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type) AS r FROM part GROUP BY p_brand, p_type) WHERE r = 1) USING (p_brand) JOIN (SELECT p_brand, p_name AS longest FROM (SELECT p_brand, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY length(p_name) DESC, p_name) AS r FROM part) WHERE r = 1) USING (p_brand)")
def entity_merge(spark, d):
    """Groups merged: most frequent type (ties alphabetical), longest description, union of aliases."""
    p = table(spark, d, "part")
    t = p.groupBy("p_brand", "p_type").agg(F.count("*").alias("n")).withColumn("r", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("n"), "p_type"))).where("r = 1")
    g = p.groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("p_type")), ",").alias("aliases"), F.min_by("p_name", F.struct(-F.char_length("p_name"), "p_name")).alias("longest"))
    return g.join(t.select("p_brand", F.col("p_type").alias("type")), "p_brand").select(F.col("p_brand").alias("name"), "type", "longest", "aliases")


@query("erm_tables", "SELECT p_brand AS tbl, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS columns, count(DISTINCT p_type) AS n_columns FROM part GROUP BY p_brand")
def erm_tables(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("tbl")).agg(F.array_join(F.array_sort(F.collect_set("p_type")), ",").alias("columns"), F.count_distinct("p_type").alias("n_columns"))


@query("export_lpg_jsonl", "SELECT '{\"type\":\"node\",\"id\":' || p_partkey || ',\"kind\":\"' || p_type || '\"}' AS line FROM part UNION ALL SELECT '{\"type\":\"edge\",\"src\":' || src || ',\"dst\":' || dst || '}' FROM (WITH " + PART_EDGES + " SELECT * FROM edges)")
def export_lpg_jsonl(spark, d):
    """Nodes and edges as JSON lines, ready for write.text."""
    n = table(spark, d, "part").select(F.to_json(F.struct(F.lit("node").alias("type"), F.col("p_partkey").alias("id"), F.col("p_type").alias("kind"))).alias("line"))
    e = part_edges(spark, d).select(F.to_json(F.struct(F.lit("edge").alias("type"), "src", "dst")).alias("line"))
    return n.union(e)


@query("export_mermaid", f"WITH {PART_EDGES} SELECT 0 AS src, 0 AS dst, 'graph LR' AS line UNION ALL SELECT src, dst, '  n' || src || ' --> n' || dst FROM edges")
def export_mermaid(spark, d):
    """The lines of the diagram, a row each; written in order of src and dst they are the whole file."""
    head = spark.range(1).select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit("graph LR").alias("line"))
    line = F.concat(F.lit("  n"), F.col("src").cast("string"), F.lit(" --> n"), F.col("dst").cast("string"))
    return head.union(part_edges(spark, d).select("src", "dst", line))


@query("test_matrix_pivot", "SELECT user_id, count(CASE WHEN event_type = 'click' THEN 1 END) AS click, count(CASE WHEN event_type = 'error' THEN 1 END) AS error, count(CASE WHEN event_type = 'purchase' THEN 1 END) AS purchase, count(CASE WHEN event_type = 'signup' THEN 1 END) AS signup, count(CASE WHEN event_type = 'view' THEN 1 END) AS view FROM events GROUP BY user_id")
def test_matrix_pivot(spark, d):
    """Case by field pivot."""
    kinds_ = ["click", "error", "purchase", "signup", "view"]
    return table(spark, d, "events").groupBy("user_id").pivot("event_type", kinds_).count().na.fill(0, kinds_)


@query("setop_union_intersect_except", "(SELECT o_custkey AS k, 'both' AS side FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT o_custkey, 'both' FROM orders WHERE o_orderstatus = 'F') UNION ALL (SELECT k, 'only_o' FROM (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'))")
def setop_union_intersect_except(spark, d):
    o = table(spark, d, "orders")
    a, b = (o.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k")) for s in "OF")
    return a.intersect(b).withColumn("side", F.lit("both")).union(a.subtract(b).withColumn("side", F.lit("only_o")))
