"""Registered queries over the test graph, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import basename, dirname, make_id_ascii
from ..functions.terms import query_terms
from ..operators import analytics, ask, cluster, graph, lookup, resolve, traverse
from . import testgraph
from .testgraph import WITH

QUESTION = "which customer orders green part from supplier"
CHANGED = ["nation_3.tbl"]
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return testgraph.nodes(spark, d), testgraph.edges(spark, d)


@query("god_nodes", f"{WITH} SELECT id, label, degree FROM flag WHERE NOT hub AND NOT concept ORDER BY degree DESC, seq LIMIT 10")
def god_nodes(spark, d):
    return analytics.god_nodes(*_graph(spark, d))


@query("degree", f"{WITH} SELECT id, degree FROM deg")
def degree(spark, d):
    return graph.with_degree(*_graph(spark, d)).select("id", "degree")


@query("adjacency", f"{WITH} SELECT id, nbr FROM adj")
def adjacency(spark, d):
    return graph.adjacency(testgraph.edges(spark, d))


@query("isolated_nodes", f"{WITH}, n AS (SELECT nodes.*, coalesce(k, 0) AS degree FROM nodes LEFT JOIN (SELECT id, count(*) AS k FROM adj GROUP BY id) USING (id)) SELECT id, label, degree, seq FROM n WHERE degree <= 1 AND source_file <> '' AND label <> source_file")
def isolated_nodes(spark, d):
    return analytics.isolated(*_graph(spark, d))


@query("node_search", f"{WITH} SELECT id, label, source_file FROM nodes WHERE regexp_matches(label, 'supplier#0+1', 'i') OR regexp_matches(id, 'supplier#0+1', 'i') OR regexp_matches(norm_label, 'supplier#0+1', 'i')")
def node_search(spark, d):
    return lookup.search(testgraph.nodes(spark, d), "supplier#0+1").select("id", "label", "source_file")


_NAMES = ["order_7", "europe", "nation_1.tbl", "customer_1", "zzz"]


@query(
    "resolve_symbol",
    f"{WITH}, q AS (SELECT unnest({_NAMES}) AS q), hit AS (SELECT q, id, label, seq, CASE WHEN id = q THEN 0 WHEN lower(label) = lower(q) THEN 1 WHEN contains(lower(label), lower(q)) OR contains(lower(id), lower(q)) THEN 2 END AS k FROM nodes, q), "
    "best AS (SELECT q, min(k) AS k FROM hit GROUP BY q) SELECT q, arg_min(id, seq) AS id, arg_min(label, seq) AS label FROM hit JOIN best USING (q, k) GROUP BY q, k HAVING k < 2 OR count(*) = 1",
)
def resolve_symbol(spark, d):
    n = testgraph.nodes(spark, d)
    out = [lookup.resolve_symbol(n, q).select(F.lit(q).alias("q"), "id", "label") for q in _NAMES]
    whole = out[0]
    for x in out[1:]:
        whole = whole.unionByName(x)
    return whole


@query(
    "explain_node",
    f"{WITH}, l AS (SELECT '->' AS dir, relation, target AS other, confidence FROM edges WHERE source = 'supplier_1' UNION ALL SELECT '<-', relation, source, confidence FROM edges WHERE target = 'supplier_1' AND source <> 'supplier_1') "
    "SELECT dir, relation, other, coalesce(label, other) AS label, confidence FROM l LEFT JOIN nodes ON other = id",
)
def explain_node(spark, d):
    return lookup.explain(*_graph(spark, d), "supplier_1")


@query(
    "node_neighbours",
    f"{WITH}, l AS (SELECT '->' AS dir, relation, target AS other, confidence FROM edges WHERE source = 'order_1' UNION ALL SELECT '<-', relation, source, confidence FROM edges WHERE target = 'order_1' AND source <> 'order_1') "
    "SELECT dir, relation, other, coalesce(label, other) AS label, confidence FROM l LEFT JOIN nodes ON other = id WHERE contains(relation, 'ort')",
)
def node_neighbours(spark, d):
    return lookup.neighbours(*_graph(spark, d), "order_1", "ORT")


@query("community_members", f"{WITH} SELECT id, label, source_file FROM nodes WHERE community = 4")
def community_members(spark, d):
    return lookup.community(testgraph.nodes(spark, d), 4)


_SURPRISE = """, c AS (SELECT e.source, e.target, s.label AS source_label, t.label AS target_label, relation, confidence, s.source_file AS source_loc, t.source_file AS target_loc,
 coalesce(s.community, 0) <> coalesce(t.community, 0) AS apart FROM edges e JOIN flag s ON e.source = s.id JOIN flag t ON e.target = t.id
 WHERE relation NOT IN ('imports', 'imports_from', 'contains') AND NOT s.hub AND NOT t.hub AND NOT s.concept AND NOT t.concept AND s.source_file <> t.source_file)
SELECT source, target, source_label, target_label, relation, confidence, source_loc, target_loc, CASE WHEN apart THEN 'bridges separate communities' ELSE '' END AS note,
 CAST(CASE confidence WHEN 'AMBIGUOUS' THEN 3 WHEN 'INFERRED' THEN 2 ELSE 1 END + CAST(apart AS INT) AS BIGINT) AS score FROM c ORDER BY score DESC, source, target, relation LIMIT 50"""


@query("surprising_edges", WITH + _SURPRISE)
def surprising_edges(spark, d):
    return analytics.surprising(*_graph(spark, d), 50)


@query("confidence_breakdown", f"{WITH} SELECT 100 * count(*) FILTER (confidence = 'EXTRACTED') // count(*) AS extracted, 100 * count(*) FILTER (confidence = 'INFERRED') // count(*) AS inferred, 100 * count(*) FILTER (confidence = 'AMBIGUOUS') // count(*) AS ambiguous FROM edges")
def confidence_breakdown(spark, d):
    return analytics.confidence_breakdown(testgraph.edges(spark, d))


@query(
    "graph_stats",
    f"{WITH} SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(DISTINCT community) FROM nodes) AS communities, count(*) AS edges, (200 * count(*) FILTER (confidence = 'EXTRACTED') + count(*)) // (2 * count(*)) AS extracted, "
    "(200 * count(*) FILTER (confidence = 'INFERRED') + count(*)) // (2 * count(*)) AS inferred, (200 * count(*) FILTER (confidence = 'AMBIGUOUS') + count(*)) // (2 * count(*)) AS ambiguous FROM edges",
)
def graph_stats(spark, d):
    return analytics.graph_stats(*_graph(spark, d))


@query("ambiguous_edges", f"{WITH} SELECT source, target, relation, s.label AS source_label, t.label AS target_label FROM edges JOIN nodes s ON source = s.id JOIN nodes t ON target = t.id WHERE confidence = 'AMBIGUOUS'")
def ambiguous_edges(spark, d):
    return analytics.ambiguous_edges(*_graph(spark, d))


@query(
    "cohesion",
    f"{WITH}, c AS (SELECT community, id FROM nodes WHERE community IS NOT NULL), k AS (SELECT a.community, count(*) AS links FROM adj JOIN c a ON adj.id = a.id JOIN c b ON nbr = b.id WHERE adj.id < nbr AND a.community = b.community GROUP BY a.community), "
    "s AS (SELECT community, count(*) AS members FROM c GROUP BY community) SELECT community, members, CASE WHEN members <= 1 THEN 1.0 ELSE coalesce(links, 0) / (members * (members - 1) / 2) END AS cohesion FROM s LEFT JOIN k USING (community)",
)
def cohesion(spark, d):
    return analytics.cohesion(testgraph.edges(spark, d), testgraph.communities(spark, d))


@query("thin_communities", f"{WITH} SELECT community, count(*) AS members FROM nodes WHERE community IS NOT NULL GROUP BY community HAVING count(*) < 700")
def thin_communities(spark, d):
    return analytics.thin_communities(testgraph.nodes(spark, d), 700)


@query("community_sizes", f"{WITH} SELECT community, count(*) AS members FROM nodes WHERE community IS NOT NULL GROUP BY community")
def community_sizes(spark, d):
    return testgraph.communities(spark, d).groupBy("community").agg(F.count("*").alias("members"))


def _levels(start: str, most: int) -> str:
    """l0 to l<most>: the least path from start to each node that is so many hops away."""
    return f", l0 AS (SELECT '{start}' AS id, '{start}' AS path), " + ", ".join(
        f"l{k} AS (SELECT nbr AS id, min(path || '>' || nbr) AS path FROM l{k - 1} JOIN adj USING (id) WHERE nbr NOT IN ({' UNION ALL '.join(f'SELECT id FROM l{j}' for j in range(k))}) GROUP BY nbr)" for k in range(1, most + 1)
    )


_PATH = _levels("supplier_1", 4)
# as lists, which compare id by id
_WAY = _levels("region_1", 4).replace("'region_1' AS path", "['region_1'] AS path").replace("path || '>' || nbr", "list_append(path, nbr)")
_PATH_EDGES = (
    f"{WITH}{_WAY}, way AS (SELECT path AS p FROM ({' UNION ALL '.join(f'SELECT * FROM l{k}' for k in range(5))}) WHERE id = 'part_3'), "
    "hop AS (SELECT k - 1 AS hop, p[k] AS u, p[k + 1] AS v FROM (SELECT p, unnest(range(1, len(p))) AS k FROM way)), "
    "link AS (SELECT hop, u, v, relation, confidence, 0 AS back FROM hop JOIN edges ON source = u AND target = v UNION ALL SELECT hop, u, v, relation, confidence, 1 FROM hop JOIN edges ON source = v AND target = u) "
    "SELECT CAST(hop AS BIGINT) AS hop, u AS source, v AS target, relation, confidence, back = 0 AS forward FROM (SELECT *, row_number() OVER (PARTITION BY hop ORDER BY back, relation, confidence) AS n FROM link) WHERE n = 1"
)


@query("shortest_path", WITH + _PATH + " SELECT len(path) - len(replace(path, '>', '')) AS hops, path FROM (" + " UNION ALL ".join(f"SELECT * FROM l{k}" for k in range(5)) + ") WHERE id = 'customer_2'")
def shortest_path(spark, d):
    found = traverse.shortest_path(testgraph.edges(spark, d), "supplier_1", "customer_2")
    return spark.createDataFrame([(len(found) - 1, ">".join(found))] if found else [], "hops long, path string")


@query("path_edges", _PATH_EDGES)
def path_edges(spark, d):
    hops = traverse.path_edges(testgraph.edges(spark, d), "region_1", "part_3")
    return spark.createDataFrame([(i, h["source"], h["target"], h["relation"], h["confidence"], h["forward"]) for i, h in enumerate(hops)], "hop long, source string, target string, relation string, confidence string, forward boolean")


def _affected(relations: str, depth: int) -> str:
    stop = f" AND k < {depth}" if depth else ""
    return (
        f"{WITH}, a(id, k) AS (SELECT id, 0 FROM nodes WHERE source_file = 'nation_3.tbl' UNION SELECT source, {'k + 1' if depth else '0'} FROM a JOIN edges ON target = a.id WHERE relation IN ({relations}){stop}), "
        "s AS (SELECT DISTINCT id FROM a) SELECT CASE WHEN source_file = 'nation_3.tbl' THEN 'changed' ELSE 'impacted' END AS change, id, label, source_file FROM s JOIN nodes USING (id)"
    )


_IMPACT = ", ".join(f"'{r}'" for r in traverse.IMPACT)


@query("affected", _affected(_IMPACT, 0))
def affected(spark, d):
    return traverse.affected(*_graph(spark, d), CHANGED)


@query("affected_depth", _affected(_IMPACT, 1))
def affected_depth(spark, d):
    return traverse.affected(*_graph(spark, d), CHANGED, depth=1)


@query("affected_relation", _affected("'depends_on'", 0))
def affected_relation(spark, d):
    return traverse.affected(*_graph(spark, d), CHANGED, ["depends_on"])


_TERMS = query_terms(QUESTION)
_IDF = (
    f"{WITH}, t AS (SELECT DISTINCT unnest({_TERMS}) AS term), idf AS (SELECT term, count(*) FILTER (contains(norm_label, term)) AS df, ln(1 + greatest(count(*), 1) / (1 + count(*) FILTER (contains(norm_label, term)))) AS idf FROM nodes, t GROUP BY term), "
    f"q AS (SELECT unnest({_TERMS}) AS term), top AS (SELECT greatest(1, max(idf)) AS top FROM idf), n AS (SELECT *, rtrim(norm_label, '()') AS bare FROM nodes), "
    f"sc AS (SELECT n.id, any_value(label) AS label, any_value(norm_label) AS norm, "
    f"any_value(CASE WHEN norm_label = '{' '.join(_TERMS)}' OR bare = '{' '.join(_TERMS)}' THEN 10000 * top WHEN starts_with(norm_label, '{' '.join(_TERMS)}') THEN 1000 * top ELSE 0 END) + sum(CASE WHEN term = norm_label OR term = bare THEN 1000 * idf "
    "WHEN starts_with(norm_label, term) OR starts_with(bare, term) THEN 100 * idf WHEN contains(norm_label, term) THEN idf ELSE 0 END + CASE WHEN contains(lower(source_file), term) THEN 0.5 * idf ELSE 0 END) AS score FROM n, q JOIN idf USING (term), top GROUP BY n.id), "
    "scored AS (SELECT id, label, norm, score, CAST(strlen(label) AS BIGINT) AS label_bytes FROM sc WHERE score > 0)"
)


@query("ask_idf", f"{_IDF} SELECT term, df, round(idf, 6) AS idf FROM idf")
def ask_idf(spark, d):
    return ask.idf(testgraph.nodes(spark, d), _TERMS).withColumn("idf", F.round("idf", 6))


@query("ask_scores", f"{_IDF} SELECT id, label, norm, round(score, 6) AS score, label_bytes FROM scored")
def ask_scores(spark, d):
    return ask.scores(testgraph.nodes(spark, d), _TERMS).withColumn("score", F.round("score", 6))


_SEEDS = ", one AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY score DESC, label_bytes, id) AS k FROM scored), few AS (SELECT *, row_number() OVER (ORDER BY score DESC, label_bytes, id) AS rank FROM one WHERE k = 1), seed AS (SELECT rank, id, score FROM few WHERE rank <= 3 AND score >= 0.2 * (SELECT max(score) FROM few))"


@query("ask_seeds", f"{_IDF}{_SEEDS} SELECT rank, id, round(score, 6) AS score FROM seed")
def ask_seeds(spark, d):
    return ask.seeds(ask.scores(testgraph.nodes(spark, d), _TERMS)).withColumn("score", F.round("score", 6))


@query("hub_threshold", f"{WITH} SELECT greatest(50, d) AS threshold FROM (SELECT d, row_number() OVER (ORDER BY d) - 1 AS k, count(*) OVER () AS n FROM (SELECT count(*) AS d FROM adj GROUP BY id)) WHERE k = least(CAST(floor(n * 0.99) AS BIGINT), n - 1)")
def hub_threshold(spark, d):
    return spark.createDataFrame([(ask.hub_threshold(graph.adjacency(testgraph.edges(spark, d))),)], "threshold long")


_BFS = (
    f"{WITH}, dg AS (SELECT id, count(*) AS d FROM adj GROUP BY id), th AS (SELECT greatest(50, d) AS threshold FROM (SELECT d, row_number() OVER (ORDER BY d) - 1 AS k, count(*) OVER () AS n FROM dg) WHERE k = least(CAST(floor(n * 0.99) AS BIGINT), n - 1)), "
    "v0 AS (SELECT unnest(['nation_3', 'part_5']) AS id), v1 AS (SELECT DISTINCT nbr AS id FROM v0 JOIN adj USING (id) WHERE nbr NOT IN (SELECT id FROM v0)), "
    "v2 AS (SELECT DISTINCT nbr AS id FROM v1 JOIN adj USING (id) JOIN dg USING (id), th WHERE dg.d < threshold AND nbr NOT IN (SELECT id FROM v0 UNION ALL SELECT id FROM v1)) "
    "SELECT id, 0 AS depth FROM v0 UNION ALL SELECT id, 1 FROM v1 UNION ALL SELECT id, 2 FROM v2"
)


@query("ask_bfs", _BFS)
def ask_bfs(spark, d):
    return ask.walk_bfs(testgraph.edges(spark, d), ["nation_3", "part_5"], 2)[0]


@query("ask_dfs")
def ask_dfs(spark, d):
    visited, met = ask.walk_dfs(testgraph.edges(spark, d), ["part_5"], 2)
    return spark.createDataFrame(list(enumerate(visited)), "place long, id string")


@query("ask_answer")
def ask_answer(spark, d):
    text = ask.ask(*_graph(spark, d), QUESTION)
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "line long, text string")


_TRADE = "trade AS (SELECT 'nation_' || c_nationkey || '.tbl' AS u, 'nation_' || s_nationkey || '.tbl' AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY ALL)"
_CYC = ", ".join(f"p{k} AS (SELECT p{k - 1}.start, v AS cur, list_append(path, v) AS path FROM p{k - 1} JOIN trade ON cur = u WHERE v < start AND NOT list_contains(path, v))" for k in range(3, 6))


@query(
    "import_cycles",
    f"WITH {_TRADE}, p2 AS (SELECT u AS start, v AS cur, [u, v] AS path FROM trade WHERE v < u), {_CYC}, closed AS ("
    + " UNION ALL ".join(f"SELECT start, path, {k} AS size FROM p{k} JOIN trade ON cur = u AND start = v" for k in range(2, 6))
    + "), first AS (SELECT * FROM closed ORDER BY start, path LIMIT 200) SELECT CAST(size AS BIGINT) AS size, array_to_string(path, ' -> ') AS files FROM first ORDER BY size, start, path LIMIT 20",
)
def import_cycles(spark, d):
    t = lambda n: spark.read.parquet(f"{d}/{n}.parquet")
    lines = t("lineitem").select("l_orderkey", "l_suppkey").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    pairs = lines.join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).where("c_nationkey <> s_nationkey")
    name = lambda c: F.concat(F.lit("nation_"), F.col(c).cast("string"), F.lit(".tbl"))
    return traverse.cycles_of(traverse.level(pairs.select(name("c_nationkey").alias("u"), name("s_nationkey").alias("v")).distinct()), 5, 20)


def _two(spark, d):
    """Two snapshots of a graph of events: users and the things they did, before and after a third of all ids."""
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", "event_type")
    old, new = e.where("event_id % 3 <> 0"), e.where("event_id % 3 <> 1")
    return [
        (
            x.select(F.expr("concat('user_', user_id, '_', event_id % 20)").alias("id")).distinct().withColumn("label", F.upper("id")),
            x.select(F.expr("concat('user_', user_id, '_', event_id % 20)").alias("source"), F.concat(F.lit("type_"), "event_type").alias("target"), F.lit("did").alias("relation")).distinct(),
        )
        for x in (old, new)
    ]


_TWO = "o AS (SELECT * FROM events WHERE event_id % 3 <> 0), n AS (SELECT * FROM events WHERE event_id % 3 <> 1)"


@query("diff_nodes", f"WITH {_TWO}, a AS (SELECT DISTINCT 'user_' || user_id || '_' || event_id % 20 AS id FROM o), b AS (SELECT DISTINCT 'user_' || user_id || '_' || event_id % 20 AS id FROM n) SELECT 'added' AS change, id, upper(id) AS label FROM b WHERE id NOT IN (SELECT id FROM a) UNION ALL SELECT 'removed', id, upper(id) FROM a WHERE id NOT IN (SELECT id FROM b)")
def diff_nodes(spark, d):
    (old, _), (new, _) = _two(spark, d)
    return lookup.diff_nodes(old, new)


@query("diff_edges", f"WITH {_TWO}, a AS (SELECT DISTINCT 'user_' || user_id || '_' || event_id % 20 AS source, 'type_' || event_type AS target, 'did' AS relation FROM o), b AS (SELECT DISTINCT 'user_' || user_id || '_' || event_id % 20 AS source, 'type_' || event_type AS target, 'did' AS relation FROM n) SELECT 'added' AS change, * FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT 'removed', * FROM (SELECT * FROM a EXCEPT SELECT * FROM b)")
def diff_edges(spark, d):
    (_, old), (_, new) = _two(spark, d)
    return lookup.diff_edges(old, new)


@query("merge_graphs", "WITH s AS (SELECT 'user_' || user_id AS id, event_type AS label, event_id AS seq, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS side FROM events) SELECT id, label, seq FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY side, seq) AS k FROM s) WHERE k = 1")
def merge_graphs(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("id"), F.col("event_type").alias("label"), F.col("event_id").alias("seq"))
    return lookup.merge(e.where("seq % 3 <> 0"), e.where("seq % 3 = 0"), ["id"])


@query(
    "validate_graph",
    "WITH n AS (SELECT CASE WHEN event_id % 97 = 0 THEN '' ELSE 'u' || (user_id % 50) END AS id FROM events), e AS (SELECT DISTINCT 'u' || (user_id % 60) AS source, 'u' || (event_id % 55) AS target, event_type AS relation FROM events), "
    "k AS (SELECT DISTINCT id FROM n WHERE id <> '') SELECT 'node has empty id' AS issue FROM n WHERE id = '' UNION ALL SELECT 'duplicate node id: ' || id || ' (' || count(*) || ' occurrences)' FROM n WHERE id <> '' GROUP BY id HAVING count(*) > 1 "
    "UNION ALL SELECT 'edge ' || source || ' -> ' || target || ' [' || relation || ']: source missing' FROM e WHERE source NOT IN (SELECT id FROM k) UNION ALL SELECT 'edge ' || source || ' -> ' || target || ' [' || relation || ']: target missing' FROM e WHERE target NOT IN (SELECT id FROM k)",
)
def validate_graph(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    u = lambda c: F.concat(F.lit("u"), c.cast("string"))
    nodes = e.select(F.when(F.col("event_id") % 97 == 0, "").otherwise(u(F.col("user_id") % 50)).alias("id"))
    edges = e.select(u(F.col("user_id") % 60).alias("source"), u(F.col("event_id") % 55).alias("target"), F.col("event_type").alias("relation")).distinct()
    return lookup.validate(nodes, edges)


_BUILD_N = "n AS (SELECT event_id AS seq, CASE WHEN user_id % 4 = 0 THEN 'User-' ELSE 'user_' END || (user_id % 40) AS id, 'd/f' || (event_id % 9) || CASE WHEN event_id % 2 = 0 THEN '.py' ELSE '.go' END AS source_file FROM events), u AS (SELECT id, min(seq) AS seq, arg_max(source_file, seq) AS source_file FROM n GROUP BY id)"
_BUILD_E = "e AS (SELECT event_id AS ord, 'user_' || (user_id % 40) AS source, 'user-' || (event_id % 45) AS target, CASE event_type WHEN 'click' THEN 'calls' WHEN 'view' THEN 'imports' ELSE 'contains' END AS relation, CASE WHEN event_id % 7 = 0 THEN 'EXTRACTED' ELSE 'INFERRED' END AS confidence FROM events)"


@query(
    "build_edges",
    f"WITH {_BUILD_N}, {_BUILD_E}, form AS (SELECT lower(trim(regexp_replace(id, '[^A-Za-z0-9]+', '_', 'g'), '_')) AS form, arg_max(id, seq) AS other FROM u GROUP BY 1), "
    "m AS (SELECT e.*, coalesce(a.id, fa.other) AS ns, coalesce(b.id, fb.other) AS nt FROM e LEFT JOIN u a ON source = a.id LEFT JOIN u b ON target = b.id LEFT JOIN form fa ON lower(regexp_replace(source, '[^A-Za-z0-9]+', '_', 'g')) = fa.form LEFT JOIN form fb ON lower(regexp_replace(target, '[^A-Za-z0-9]+', '_', 'g')) = fb.form), "
    "k AS (SELECT m.*, right(x.source_file, 3) <> right(y.source_file, 3) AS cross_ FROM m JOIN u x ON ns = x.id JOIN u y ON nt = y.id), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY ns, nt, relation ORDER BY source, target, ord) AS k FROM k WHERE NOT (cross_ AND ((relation = 'calls' AND confidence = 'INFERRED') OR relation IN ('imports', 'imports_from', 'references')))) SELECT ns AS source, nt AS target, relation, confidence, ord FROM r WHERE k = 1",
)
def build_edges(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    s = lambda c: c.cast("string")
    user = F.when(F.col("user_id") % 4 == 0, F.lit("User-")).otherwise("user_")
    raw = e.select(F.col("event_id").alias("seq"), F.concat(user, s(F.col("user_id") % 40)).alias("id"), F.concat(F.lit("d/f"), s(F.col("event_id") % 9), F.when(F.col("event_id") % 2 == 0, ".py").otherwise(".go")).alias("source_file"))
    relation = F.when(F.col("event_type") == "click", "calls").when(F.col("event_type") == "view", "imports").otherwise("contains")
    links = e.select(F.concat(F.lit("user_"), s(F.col("user_id") % 40)).alias("source"), F.concat(F.lit("user-"), s(F.col("event_id") % 45)).alias("target"), relation.alias("relation"), F.when(F.col("event_id") % 7 == 0, "EXTRACTED").otherwise("INFERRED").alias("confidence"), F.col("event_id").alias("ord"))
    return graph.reconcile_edges(graph.upsert_nodes(raw), links, make_id_ascii)


@query("upsert_nodes", f"WITH {_BUILD_N} SELECT id, seq, source_file FROM u")
def upsert_nodes(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    user = F.when(F.col("user_id") % 4 == 0, F.lit("User-")).otherwise("user_")
    return graph.upsert_nodes(e.select(F.col("event_id").alias("seq"), F.concat(user, (F.col("user_id") % 40).cast("string")).alias("id"), F.concat(F.lit("d/f"), (F.col("event_id") % 9).cast("string"), F.when(F.col("event_id") % 2 == 0, ".py").otherwise(".go")).alias("source_file")))


# A made-up code base of events: a call for each, definitions for some, imports for some.
_FILE = "'pkg' || (user_id % 5) || '/mod' || (user_id % 30) || CASE WHEN user_id % 3 = 0 THEN '.py' ELSE '.go' END"
_DEFS = f"defs AS (SELECT 'def_' || event_id AS id, 'f' || (event_id % 211) AS name, {_FILE} AS file, event_id AS ord FROM events WHERE event_id % 4 = 0)"
_CALLS = f"calls AS (SELECT 'def_' || (event_id - event_id % 4) AS caller_id, 'f' || (event_id % 197) AS callee, {_FILE} AS file, 'L' || (event_id % 90) AS loc, event_id AS ord FROM events)"
_IMPD = f"imported AS (SELECT DISTINCT {_FILE} AS file, 'pkg' || ((user_id + 1) % 5) || '/mod' || ((user_id + 7) % 30) || CASE WHEN (user_id + 7) % 3 = 0 THEN '.py' ELSE '.go' END AS target FROM events WHERE event_id % 3 = 0)"


@query(
    "call_resolution",
    f"WITH {_DEFS}, {_CALLS}, {_IMPD}, idf AS (SELECT id, arg_max(file, ord) AS file FROM defs GROUP BY id), loc_ AS (SELECT file, name, arg_max(id, ord) AS id FROM defs GROUP BY file, name), "
    "c AS (SELECT calls.*, row_number() OVER () AS r FROM calls), cand AS (SELECT c.r, d.id, i.file AS dfile, m.target IS NOT NULL AS imp, regexp_replace(c.file, '/[^/]*$', '') = regexp_replace(i.file, '/[^/]*$', '') AS same FROM c JOIN defs d ON c.callee = d.name JOIN idf i ON d.id = i.id LEFT JOIN imported m ON m.file = c.file AND m.target = i.file), "
    "g AS (SELECT r, CASE WHEN count(*) = 1 THEN min(id) WHEN count(*) FILTER (imp) = 1 THEN min(id) FILTER (imp) WHEN count(*) FILTER (same) = 1 THEN min(id) FILTER (same) END AS id FROM cand GROUP BY r), "
    "t AS (SELECT c.*, coalesce(l.id, g.id) AS target FROM c LEFT JOIN loc_ l ON c.file = l.file AND c.callee = l.name LEFT JOIN g USING (r)) "
    "SELECT caller_id AS source, target, 'calls' AS relation, 'INFERRED' AS confidence, t.file AS source_file, loc AS source_location FROM t JOIN idf ON target = idf.id WHERE target <> caller_id AND right(t.file, 3) = right(idf.file, 3)",
)
def call_resolution(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    files = F.expr("concat('pkg', user_id % 5, '/mod', user_id % 30, IF(user_id % 3 = 0, '.py', '.go'))")
    defs = e.where("event_id % 4 = 0").select(F.expr("concat('def_', event_id)").alias("id"), F.expr("concat('f', event_id % 211)").alias("name"), files.alias("file"), F.col("event_id").alias("ord"))
    calls = e.select(F.expr("concat('def_', event_id - event_id % 4)").alias("caller_id"), F.expr("concat('f', event_id % 197)").alias("callee"), files.alias("file"), F.expr("concat('L', event_id % 90)").alias("loc"), F.col("event_id").alias("ord"))
    imported = e.where("event_id % 3 = 0").select(files.alias("file"), F.expr("concat('pkg', (user_id + 1) % 5, '/mod', (user_id + 7) % 30, IF((user_id + 7) % 3 = 0, '.py', '.go'))").alias("target")).distinct()
    return resolve.resolve_calls(calls, defs, imported).drop("ord")


_IMPORTS = "f AS (SELECT DISTINCT 'src/m' || (event_id % 40) || CASE event_id % 4 WHEN 0 THEN '.ts' WHEN 1 THEN '/index.js' WHEN 2 THEN '.d.ts' ELSE '.jsx' END AS path FROM events), i AS (SELECT DISTINCT 'src/a' || (user_id % 20) || '.ts' AS file, CASE WHEN user_id % 3 = 0 THEN 'lib' || (user_id % 11) ELSE './m' || (event_id % 50) END AS spec FROM events)"
_EXTS = [".ts", ".mts", ".cts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".d.ts"]


@query(
    "import_resolution",
    f"WITH {_IMPORTS}, x AS (SELECT unnest({['', *_EXTS, *['/index' + x for x in _EXTS]]}) AS ext, unnest(range(19)) AS rank), c AS (SELECT file, spec, arg_min(path, rank) AS target FROM i, x JOIN f ON path = 'src/' || substr(spec, 3) || ext WHERE spec LIKE './%' GROUP BY file, spec) "
    "SELECT i.file, i.spec, c.target FROM i LEFT JOIN c USING (file, spec)",
)
def import_resolution(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    files = e.select(F.expr("concat('src/m', event_id % 40, CASE event_id % 4 WHEN 0 THEN '.ts' WHEN 1 THEN '/index.js' WHEN 2 THEN '.d.ts' ELSE '.jsx' END)").alias("path")).distinct()
    imports = e.select(F.expr("concat('src/a', user_id % 20, '.ts')").alias("file"), F.expr("IF(user_id % 3 = 0, concat('lib', user_id % 11), concat('./m', event_id % 50))").alias("spec")).distinct()
    return resolve.relative_imports(imports, files).select("file", "spec", "target")


@query(
    "incremental_plan",
    "WITH o AS (SELECT doc_id AS path, sha256(text) AS hash FROM documents WHERE doc_id % 7 <> 0), n AS (SELECT doc_id AS path, sha256(CASE WHEN doc_id % 5 = 0 THEN text || 'x' ELSE text END) AS hash FROM documents WHERE doc_id % 11 <> 0) "
    "SELECT CASE WHEN n.path IS NULL THEN 'dropped' WHEN o.hash = n.hash THEN 'reused' ELSE 'parsed' END AS action, count(*) AS files FROM o FULL JOIN n ON o.path = n.path GROUP BY 1",
)
def incremental_plan(spark, d):
    from ..streaming.incremental import plan_update

    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    old = docs.where("doc_id % 7 <> 0").select(F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("hash"))
    new = docs.where("doc_id % 11 <> 0").select(F.col("doc_id").cast("string").alias("path"), F.sha2(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("hash"))
    return plan_update(old, new).groupBy("action").agg(F.count("*").alias("files"))


@query("html_links", "SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS target FROM pages")
def html_links(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet").select("page_id", "html")
    return pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("target"))


@query("community_overlap", f"{WITH} SELECT CAST(community AS BIGINT) AS old, CAST(seq % 25 AS BIGINT) AS new, count(*) AS n FROM nodes WHERE community IS NOT NULL GROUP BY 1, 2")
def community_overlap(spark, d):
    n = testgraph.nodes(spark, d).where("community IS NOT NULL")
    return cluster.overlap(n.select(F.col("community").cast("long").alias("community"), "id"), n.select((F.col("seq") % 25).alias("community"), "id"))


@query("make_id", "SELECT event_id, lower(trim(regexp_replace(trim(event_type, '_.') || '_' || trim(' Mod' || user_id || '.py()', '_.'), '[^A-Za-z0-9]+', '_', 'g'), '_')) AS id FROM events")
def make_id(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", make_id_ascii(F.col("event_type"), F.concat(F.lit(" Mod"), F.col("user_id").cast("string"), F.lit(".py()"))).alias("id"))


@query("path_parts", f"{WITH} SELECT DISTINCT source_file, regexp_replace(source_file, '^.*/', '') AS base, CASE WHEN contains(source_file, '/') THEN regexp_replace(source_file, '/[^/]*$', '') ELSE '.' END AS dir FROM nodes")
def path_parts(spark, d):
    return testgraph.nodes(spark, d).select("source_file", basename(F.col("source_file")).alias("base"), dirname(F.col("source_file")).alias("dir")).distinct()


@query("communities")
def communities(spark, d):
    return cluster.cluster(*_graph(spark, d))
