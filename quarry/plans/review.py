"""Named queries of findings, evidence, communities, projections and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import graphs, iterate, review, search
from quarry.plans.frames import KINDS, PART_EDGES, TOUCHES, FILES, commit_parts, files, kinds, part_edges, touches
from quarry.plans.history import FIND, findings
from quarry.plans.registry import query
from quarry.sources.tables import table


@query("critical_inferred_nodes", f"WITH n AS ({KINDS}) SELECT id, kind FROM n WHERE kind IN ('class', 'module') AND (id % 100) / 100.0 < 0.65 AND id % 3 = 0")
def critical_inferred_nodes(spark, d):
    n = kinds(table(spark, d, "part"))
    return n.where(F.col("kind").isin("class", "module") & ((F.col("id") % 100) / 100.0 < 0.65) & (F.col("id") % 3 == 0)).select("id", "kind")


@query("community_profile", "WITH n AS (SELECT p_brand AS community, p_type AS domain, count(*) AS n FROM part GROUP BY 1, 2) SELECT community, CAST(sum(n) AS BIGINT) AS size, first(domain ORDER BY n DESC, domain) AS dominant, max(n) * 1.0::DOUBLE / sum(n) AS ratio, count(*) AS domains FROM n GROUP BY community")
def community_profile(spark, d):
    return review.community_profile(table(spark, d, "part").select(F.col("p_brand").alias("community"), F.col("p_type").alias("domain")))


@query("misplaced_nodes", "WITH n AS (SELECT p_brand AS community, p_type AS domain, count(*) AS n FROM part GROUP BY 1, 2), p AS (SELECT community, first(domain ORDER BY n DESC, domain) AS dominant, max(n) * 1.0 / sum(n) AS ratio FROM n GROUP BY community) SELECT p_partkey AS id, p_brand AS community FROM part JOIN p ON community = p_brand WHERE ratio >= 0.2 AND p_type <> dominant")
def misplaced_nodes(spark, d):
    """Members outside their community's dominant domain, where it is dominant enough."""
    m = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("community"), F.col("p_type").alias("domain"))
    return m.join(review.community_profile(m), "community").where("ratio >= 0.2 and domain <> dominant").select("id", "community")


@query("community_cohesion", f"WITH {PART_EDGES}, u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges), m AS (SELECT p_partkey AS id, p_brand AS community FROM part), i AS (SELECT x.community, count(*) AS n FROM u JOIN m x ON x.id = a JOIN m y ON y.id = b WHERE x.community = y.community GROUP BY 1), c AS (SELECT community, count(*) AS n FROM m GROUP BY 1) SELECT community, c.n, CASE WHEN c.n > 1 THEN coalesce(i.n, 0) / (c.n * (c.n - 1) / 2.0::DOUBLE) ELSE 0 END AS cohesion FROM c LEFT JOIN i USING (community)")
def community_cohesion(spark, d):
    e = part_edges(spark, d).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    return review.cohesion(e, table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("community")))


@query("candidate_selection", "WITH c AS (SELECT label, vec_id, ((vec_id * 37) % 101) / 100.0::DOUBLE AS score FROM embeddings), b AS (SELECT *, max(score) OVER (PARTITION BY label) AS best FROM c), k AS (SELECT * FROM b WHERE score >= 0.6 AND score >= best - 0.06) SELECT label, vec_id, count(*) OVER (PARTITION BY label) > 1 AS ambiguous FROM k")
def candidate_selection(spark, d):
    c = table(spark, d, "embeddings").select("label", "vec_id", ((F.col("vec_id") * 37 % 101) / 100.0).alias("score"))
    return review.select_candidates(c, "label", "score", 0.6, 0.06).select("label", "vec_id", "ambiguous")


@query("entity_resolution", """WITH RECURSIVE e AS (SELECT vec_id AS id, label, CASE WHEN vec_id % 3 = 0 THEN 'OTHER' WHEN vec_id % 3 = 1 THEN 'A' ELSE 'B' END AS type, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    l AS (SELECT a.id AS a, b.id AS b FROM e a JOIN e b ON a.label = b.label AND a.id < b.id AND (a.type = b.type OR a.type = 'OTHER' OR b.type = 'OTHER') WHERE list_cosine_similarity(a.v, b.v) >= 0.85), u AS (SELECT a, b FROM l UNION SELECT b, a FROM l), r(id, t) AS (SELECT id, id FROM e UNION SELECT r.id, u.b FROM r JOIN u ON u.a = r.t)
    SELECT id, min(t) AS entity FROM r GROUP BY id""")  # fmt: skip
def entity_resolution(spark, d):
    t = F.when(F.col("vec_id") % 3 == 0, "OTHER").when(F.col("vec_id") % 3 == 1, "A").otherwise("B")
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("block"), t.alias("type"), F.col("embedding").alias("vector"))
    return review.resolve_entities(e)


@query("evidence_support", "SELECT user_id, least(1, greatest(0, 0.4 * least(count(*) / 5.0, 1) + 0.4 * avg((event_id % 100) / 100.0) + least(0.1 * count(DISTINCT event_type), 0.3) + 0.1))::DOUBLE AS support FROM events GROUP BY user_id")
def evidence_support(spark, d):
    e = table(spark, d, "events").select("user_id", ((F.col("event_id") % 100) / 100.0).alias("score"), F.col("event_type").alias("provenance"))
    return review.evidence_support(e, "user_id")


@query("bfs_page_order", f"""WITH {PART_EDGES}, u AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), l1 AS (SELECT DISTINCT dst AS id FROM u WHERE src = 1 AND dst <> 1), l2 AS (SELECT DISTINCT dst AS id FROM u WHERE src IN (SELECT id FROM l1) AND dst <> 1 AND dst NOT IN (SELECT id FROM l1)),
    a AS (SELECT 1 AS id, 0 AS level UNION ALL SELECT id, 1 FROM l1 UNION ALL SELECT id, 2 FROM l2) SELECT id, row_number() OVER (ORDER BY level, id) - 1 AS position FROM a""")  # fmt: skip
def bfs_page_order(spark, d):
    start = table(spark, d, "part").where("p_partkey = 1").select(F.col("p_partkey").alias("id"))
    return review.bfs_order(part_edges(spark, d), start, 2)


@query("process_detection")
def process_detection(spark, d):
    """Bounded simple paths from entry points; tested on a small graph."""
    p = review.processes(part_edges(spark, d))
    return p.select(F.array_join(F.col("path").cast("array<string>"), ">").alias("path"), "length")


@query("layout_projection")
def layout_projection(spark, d):
    """2-D layout of vectors by a seeded random projection."""
    return review.random_projection(table(spark, d, "embeddings"))


@query("membership_hash", "SELECT p_brand, sha256(string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey)) AS hash FROM part GROUP BY p_brand")
def membership_hash(spark, d):
    m = F.array_sort(F.collect_list("p_partkey")).cast("array<string>")
    return table(spark, d, "part").groupBy("p_brand").agg(F.sha2(F.array_join(m, ","), 256).alias("hash"))


@query("codebase_summary", f"WITH n AS ({KINDS}) SELECT count(*) AS nodes, count(CASE WHEN kind = 'class' THEN 1 END) AS classes, count(CASE WHEN kind = 'function' THEN 1 END) AS functions, count(CASE WHEN kind = 'method' THEN 1 END) AS methods, count(CASE WHEN parent IS NULL THEN 1 END) AS roots FROM n")
def codebase_summary(spark, d):
    c = lambda cond, name: F.count_if(cond).alias(name)
    k = F.col("kind")
    return kinds(table(spark, d, "part")).agg(F.count("*").alias("nodes"), c(k == "class", "classes"), c(k == "function", "functions"), c(k == "method", "methods"), c(F.col("parent").isNull(), "roots"))


@query("surface_counts", f"WITH n AS ({KINDS}) SELECT kind, count(*) AS n FROM n GROUP BY kind")
def surface_counts(spark, d):
    return kinds(table(spark, d, "part")).groupBy("kind").agg(F.count("*").alias("n"))


@query("diff_event_totals", "SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total, count(*) AS n FROM events WHERE event_id BETWEEN 100 AND 5000 GROUP BY event_type")
def diff_event_totals(spark, d):
    """Payload counters summed over a version interval."""
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "long")
    return table(spark, d, "events").where("event_id between 100 and 5000").groupBy("event_type").agg(F.sum(k).alias("total"), F.count("*").alias("n"))


@query("twin_status", "WITH l AS (SELECT user_id, first(event_type ORDER BY ts DESC, event_id DESC) AS state FROM events GROUP BY user_id) SELECT count(*) AS sources, count(CASE WHEN state = 'error' THEN 1 END) AS failed, count(CASE WHEN state = 'purchase' THEN 1 END) AS ready, CASE WHEN count(CASE WHEN state = 'error' THEN 1 END) > 0 THEN 'degraded' WHEN count(CASE WHEN state = 'purchase' THEN 1 END) = count(*) THEN 'ready' ELSE 'building' END AS status FROM l")
def twin_status(spark, d):
    """Latest state of each source, counted, and the status by precedence."""
    s = table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"))
    a = s.agg(F.count("*").alias("sources"), F.count_if(F.col("state") == "error").alias("failed"), F.count_if(F.col("state") == "purchase").alias("ready"))
    return a.withColumn("status", F.when(F.col("failed") > 0, "degraded").when(F.col("ready") == F.col("sources"), "ready").otherwise("building"))


@query("ports_dedupe", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 10 DESC, event_id % 7 DESC, event_id) AS r FROM events) WHERE r = 1")
def ports_dedupe(spark, d):
    """Best fact per id by confidence, then evidence count."""
    k = F.col("event_id")
    return review.best_by(table(spark, d, "events"), "user_id", F.desc(k % 10), F.desc(k % 7), k).select("user_id", "event_id")


@query("rule_match", "SELECT item_id FROM benchmark WHERE contains(lower(text), 'tion') OR contains(lower(text), 'the')")
def rule_match(spark, d):
    """Any query word of more than two letters in the text."""
    words = F.filter(F.split(F.lit("tion of the"), " "), lambda w: F.char_length(w) > 2)
    return table(spark, d, "benchmark").where(F.exists(words, lambda w: F.lower("text").contains(w))).select("item_id")


@query("canonical_relationships", "WITH r AS (SELECT l_partkey % 50 AS a, l_suppkey % 50 AS b, l_quantity AS strength, l_orderkey * 10 + l_linenumber AS k FROM lineitem WHERE l_partkey % 50 <> l_suppkey % 50) SELECT a, b, k FROM (SELECT a, b, k, row_number() OVER (PARTITION BY a, b ORDER BY strength DESC, k) AS n FROM r) WHERE n = 1")
def canonical_relationships(spark, d):
    """Names mapped to canonical entities, loops dropped, the strongest relationship of each pair kept."""
    r = table(spark, d, "lineitem").select((F.col("l_partkey") % 50).alias("a"), (F.col("l_suppkey") % 50).alias("b"), F.col("l_quantity").alias("s"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k")).where("a <> b")
    return r.groupBy("a", "b").agg(F.min_by("k", F.struct((-F.col("s")).alias("s"), "k")).alias("k"))


@query("endpoint_token_index", "SELECT t AS token, count(DISTINCT p_partkey) AS n, min(p_partkey) AS first_id FROM (SELECT p_partkey, unnest(regexp_extract_all(lower(p_name), '[a-z]+')) AS t FROM part) GROUP BY t")
def endpoint_token_index(spark, d):
    """Inverted index of name tokens."""
    t = table(spark, d, "part").select("p_partkey", F.explode(search.tokens(F.col("p_name"))).alias("token"))
    return t.groupBy("token").agg(F.count_distinct("p_partkey").alias("n"), F.min("p_partkey").alias("first_id"))


@query("vote_confidence", "SELECT user_id, first(event_type ORDER BY n DESC, event_type) AS winner, max(n) * 1.0::DOUBLE / sum(n) AS confidence FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY user_id")
def vote_confidence(spark, d):
    """Share of samples that agree with the most frequent signature."""
    v = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return v.groupBy("user_id").agg(F.min_by("event_type", F.struct((-F.col("n")).alias("m"), "event_type")).alias("winner"), (F.max("n") / F.sum("n")).alias("confidence"))


@query("judged_findings", f"WITH f AS ({FIND}) SELECT id FROM f WHERE subject IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AND id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def judged_findings(spark, d):
    """Findings that cite an allowed candidate and allowed evidence."""
    ok = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("subject"))
    ev = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))
    return findings(spark, d).join(ok, "subject", "left_semi").join(ev, "id", "left_semi").select("id")


@query("fitness_coupling_rule", f"WITH t AS ({TOUCHES}), f AS ({FILES}), p AS (SELECT DISTINCT commit, container AS e FROM t JOIN f USING (file)), n AS (SELECT e, count(*) AS n FROM p GROUP BY e), c AS (SELECT a.e AS a, b.e AS b, count(*) AS co FROM p a JOIN p b ON a.commit = b.commit AND a.e < b.e GROUP BY 1, 2) SELECT a, b, CASE WHEN co * 1.0 / (x.n + y.n - co) >= 0.09 THEN 'high' ELSE 'medium' END AS severity FROM c JOIN n x ON x.e = a JOIN n y ON y.e = b WHERE co * 1.0 / (x.n + y.n - co) >= 0.07")
def fitness_coupling_rule(spark, d):
    """Cross-boundary coupling findings by two thresholds."""
    from quarry.operators.changes import pairings

    j = pairings(touches(spark, d).join(files(spark, d), "file"), "container", parts=commit_parts(spark, d)).where("jaccard >= 0.07")
    return j.select("a", "b", F.when(F.col("jaccard") >= 0.09, "high").otherwise("medium").alias("severity"))


@query("fitness_cycles", f"""WITH RECURSIVE {PART_EDGES}, m AS (SELECT p_partkey AS id, min(p_partkey) OVER (PARTITION BY p_brand, p_type) AS entity FROM part),
    e AS (SELECT a.entity AS src, b.entity AS dst FROM edges JOIN m a ON src = a.id JOIN m b ON dst = b.id WHERE a.entity <> b.entity GROUP BY 1, 2 HAVING count(*) >= 2),
    r(x, y) AS (SELECT src, dst FROM e UNION SELECT r.x, e.dst FROM r JOIN e ON e.src = r.y),
    c AS (SELECT f.x AS id, max(greatest(f.x, f.y)) AS component FROM r f JOIN r g ON f.x = g.y AND f.y = g.x WHERE f.x <> f.y GROUP BY f.x) SELECT component, count(*) AS size FROM c GROUP BY component""")  # fmt: skip
def fitness_cycles(spark, d):
    """Dependency cycles between components: strongly connected entities of the lifted graph (known by their least part), with sizes."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_brand", "p_type")
    entities = p.groupBy("p_brand", "p_type").agg(F.min("id").alias("entity"))
    e = graphs.lift(part_edges(spark, d), p.join(entities, ["p_brand", "p_type"]).select("id", "entity")).where("weight >= 2").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    return iterate.strongly_connected(e).groupBy("component").agg(F.count("*").alias("size"))


@query("findings_sarif", f"WITH f AS ({FIND}) SELECT '{{\"ruleId\":\"' || rule || '\",\"level\":\"' || CASE WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity = 'medium' THEN 'warning' ELSE 'note' END || '\",\"message\":{{\"text\":\"order ' || id || '\"}}}}' AS result FROM f WHERE status = 'P'")
def findings_sarif(spark, d):
    """Findings as SARIF result objects."""
    level = F.when(F.col("severity").isin("critical", "high"), "error").when(F.col("severity") == "medium", "warning").otherwise("note")
    r = F.struct(F.col("rule").alias("ruleId"), level.alias("level"), F.struct(F.concat(F.lit("order "), F.col("id").cast("string")).alias("text")).alias("message"))
    return findings(spark, d).where("status = 'P'").select(F.to_json(r).alias("result"))


@query("twin_manifest", f"WITH {PART_EDGES}, n AS ({KINDS}) SELECT '{{\"nodes\":' || (SELECT count(*) FROM n) || ',\"edges\":' || (SELECT count(*) FROM edges) || '}}' AS manifest")
def twin_manifest(spark, d):
    a = kinds(table(spark, d, "part")).agg(F.count("*").alias("nodes"))
    b = part_edges(spark, d).agg(F.count("*").alias("edges"))
    return a.crossJoin(F.broadcast(b)).select(F.to_json(F.struct("nodes", "edges")).alias("manifest"))  # one row each


@query("mermaid_erd", "SELECT 'erDiagram' || chr(10) || string_agg('  ' || replace(p_brand, '#', '_') || ' { ' || t || ' }', chr(10) ORDER BY p_brand) AS diagram FROM (SELECT p_brand, string_agg(DISTINCT p_type, ' ' ORDER BY p_type) AS t FROM part GROUP BY p_brand)")
def mermaid_erd(spark, d):
    t = table(spark, d, "part").groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("p_type")), " ").alias("t"))
    line = F.concat(F.lit("  "), F.replace("p_brand", F.lit("#"), F.lit("_")), F.lit(" { "), F.col("t"), F.lit(" }"))
    return t.agg(F.concat(F.lit("erDiagram\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_brand", line.alias("l")))), lambda x: x["l"]), "\n")).alias("diagram"))


@query("user_flow_steps", "SELECT user_id, string_agg(event_type, '>' ORDER BY ts, event_id) AS flow FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r <= 6 GROUP BY user_id")
def user_flow_steps(spark, d):
    """The first six ordered steps of each user."""
    from pyspark.sql.window import Window

    e = table(spark, d, "events").withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).where("r <= 6")
    return e.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "event_type"))), lambda x: x["event_type"]), ">").alias("flow"))


@query("read_only_graph_sql", f"WITH {PART_EDGES} SELECT dst, count(*) AS n FROM edges GROUP BY dst HAVING count(*) > 1")
def read_only_graph_sql(spark, d):
    """Ad-hoc read-only SQL over nodes and edges views."""
    return review.read_only_sql(spark, "SELECT dst, count(*) AS n FROM edges GROUP BY dst HAVING count(*) > 1", edges=part_edges(spark, d))


@query("json_patch_apply", "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'patched2' WHEN p_partkey % 2 = 0 THEN 'patched1' ELSE p_type END AS kind FROM part")
def json_patch_apply(spark, d):
    """Ordered replace operations on a scenario: the last operation of a key wins."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("kind"))
    ops = p.where("id % 2 = 0").select("id", F.lit(1).alias("seq"), F.lit("patched1").alias("v")).union(p.where("id % 3 = 0").select("id", F.lit(2), F.lit("patched2")))
    return p.join(ops.groupBy("id").agg(F.max_by("v", "seq").alias("v")), "id", "left").select("id", F.coalesce("v", "kind").alias("kind"))
