"""Graph work: parts and suppliers of `lineitem` as a co-occurrence graph, region to orders as lineage."""

from __future__ import annotations

from pyspark.sql import functions as F

from velarium.operators import graph as G
from velarium.queries.base import Book
from velarium.shared import stored

book = Book()

_REL = "(SELECT l_partkey AS subject, l_returnflag AS relation, l_suppkey AS object, l_linenumber AS segment FROM lineitem)"


def _edges(t):
    """Parts and suppliers, keyed apart: suppliers are negative."""
    return t("lineitem").groupBy(F.col("l_partkey").alias("src"), (-1 - F.col("l_suppkey")).alias("dst")).agg(F.count(F.lit(1)).cast("double").alias("weight"))


_E = "(SELECT l_partkey AS src, -1 - l_suppkey AS dst, count(*)::double AS weight FROM lineitem GROUP BY ALL)"


def _lineage(t):
    pair = lambda name, p, c, a, b: t(name).select(F.concat(F.lit(a), F.col(p).cast("string")).alias("parent"), F.concat(F.lit(b), F.col(c).cast("string")).alias("child"))
    return pair("nation", "n_regionkey", "n_nationkey", "r", "n").unionByName(pair("customer", "c_nationkey", "c_custkey", "n", "c")).unionByName(pair("orders", "o_custkey", "o_orderkey", "c", "o"))


_L = "(SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders)"


@book.query(f"WITH RECURSIVE d AS (SELECT parent, child, 1 AS depth FROM {_L} WHERE parent = 'r1' UNION ALL SELECT e.parent, e.child, d.depth + 1 FROM d JOIN {_L} e ON e.parent = d.child) SELECT * FROM d")
def lineage_descendants(t):
    roots = t("region").filter("r_regionkey = 1").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"))
    return G.lineage(_lineage(t), roots)


@book.query(f"WITH RECURSIVE d AS (SELECT child, 1 AS depth FROM {_L} WHERE parent = 'n3' UNION ALL SELECT e.child, d.depth + 1 FROM d JOIN {_L} e ON e.parent = d.child) SELECT child, min(depth) AS depth FROM d WHERE child LIKE 'o%' GROUP BY child")
def lineage_filtered(t):
    roots = t("nation").filter("n_nationkey = 3").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node"))
    return G.lineage(_lineage(t), roots, distinct=True).filter(F.col("child").startswith("o"))


@book.query(f"WITH e AS {_E}, b AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e), h1 AS (SELECT DISTINCT dst AS node FROM b WHERE src = 1), h2 AS (SELECT DISTINCT dst AS node FROM b WHERE src IN (SELECT node FROM h1) AND dst <> 1 AND dst NOT IN (SELECT node FROM h1)) SELECT 1::bigint AS node, 0 AS hops UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2")
def bfs_reachable(t):
    seeds = t("part").filter("p_partkey = 1").select(F.col("p_partkey").alias("node"))
    return G.reachable(_edges(t), seeds, 2)


@book.query(f"""SELECT CASE WHEN subject IN (SELECT p_partkey FROM part WHERE p_size = 7) THEN 0 ELSE subject END AS subject, relation, object, count(*) AS weight, array_to_string(list(segment ORDER BY segment), ',') AS segments
    FROM {_REL} WHERE CASE WHEN subject IN (SELECT p_partkey FROM part WHERE p_size = 7) THEN 0 ELSE subject END <> object GROUP BY 1, 2, 3""")
def relationship_collapse(t):
    relations = t("lineitem").select(F.col("l_partkey").alias("subject"), F.col("l_returnflag").alias("relation"), F.col("l_suppkey").alias("object"), F.col("l_linenumber").alias("segment"))
    canonical = t("part").filter("p_size = 7").select(F.col("p_partkey").alias("orig"), F.lit(0).cast("long").alias("global"))
    # suppliers are another kind of node: their keys are negated, so that the map does not meet them
    out = G.collapsed(relations.withColumn("object", -1 - F.col("object")), canonical).withColumn("object", -1 - F.col("object"))
    return out.filter("subject <> object").withColumn("segments", F.array_join(F.col("segments").cast("array<string>"), ","))


@book.query(f"SELECT least(src, dst) AS a, greatest(src, dst) AS b, sum(weight) AS weight FROM {_E} WHERE src <> dst GROUP BY ALL")
def graph_simplify(t):
    return G.simplified(_edges(t))


@book.query(f"""
    WITH r AS (SELECT src, dst, sum(weight) AS weight FROM {_E} GROUP BY ALL), y AS (SELECT l_partkey AS src, -1 - l_suppkey AS dst, max(l_quantity) AS weight FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL),
    m AS (SELECT DISTINCT l_partkey AS src, -1 - l_suppkey AS dst, 1.0 AS weight FROM lineitem WHERE l_quantity > 45)
    SELECT src, dst, round(arg_max(weight, p), 4) AS weight FROM (SELECT *, 0 AS p FROM r UNION ALL SELECT *, 1 FROM y UNION ALL SELECT *, 2 FROM m) GROUP BY ALL""")
def graph_weights_merged(t):
    ends = lambda df: df.select(F.col("l_partkey").alias("src"), (-1 - F.col("l_suppkey")).alias("dst"), F.col("l_quantity").alias("weight"))
    typed = ends(t("lineitem").filter("l_returnflag = 'R'"))
    members = ends(t("lineitem").filter("l_quantity > 45")).select("src", "dst").distinct()
    return G.merged_weights(_edges(t), typed, members).withColumn("weight", F.round("weight", 4))


@book.query(f"SELECT src, dst FROM {_E} WHERE src IN (SELECT p_partkey FROM part WHERE p_size > 25) AND dst IN (SELECT -1 - s_suppkey FROM supplier WHERE s_acctbal > 0)")
def edges_with_ends(t):
    nodes = t("part").filter("p_size > 25").select(F.col("p_partkey").alias("node")).unionByName(t("supplier").filter("s_acctbal > 0").select((-1 - F.col("s_suppkey")).alias("node")))
    return G.with_ends(_edges(t), nodes).select("src", "dst")


@book.query("""
    WITH f AS (SELECT p_brand AS grp, p_partkey AS k, p_name AS name, p_size AS segment FROM part)
    SELECT grp, first(name ORDER BY segment, k) AS name, array_to_string(list(k ORDER BY k), ',') AS merged_from, min(segment) AS first_seen, max(segment) AS last_seen FROM f GROUP BY grp""")
def canonical_entities(t):
    rows = t("part").select(F.col("p_brand").alias("grp"), F.col("p_partkey").alias("k"), F.col("p_name").alias("name"), F.col("p_size").alias("segment"))
    out = G.canonical_entities(rows, "grp", "k", "segment", ["name"])
    return out.withColumn("merged_from", F.array_join(F.col("merged_from").cast("array<string>"), ","))


def _events(t, group=None, index=None):
    """Orders as events of their customer: embedding of the order's residue, parts as members."""
    group, index = F.col("o_custkey") % 97 if group is None else group, F.struct("at", "o") if index is None else index
    parts = t("lineitem").groupBy(F.col("l_orderkey").alias("o")).agg(F.array_sort(F.collect_set(F.col("l_partkey") % 40)).alias("members"))
    vectors = t("embeddings").select(F.col("vec_id"), "embedding")
    orders = t("orders").select(group.alias("grp"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("o"))
    n = t("embeddings").agg(F.count(F.lit(1)).alias("n"))
    keyed = orders.join(F.broadcast(n)).withColumn("vec_id", F.col("o") % F.col("n"))
    return keyed.join(parts, "o").join(vectors, "vec_id").select("grp", index.alias("idx"), "o", "embedding", "members")


_EV = """
    ev AS (SELECT o_custkey % 97 AS grp, o_orderdate AS tm, o_orderkey AS o, embedding::double[] AS v, members FROM orders
        JOIN (SELECT l_orderkey, list_distinct(list(l_partkey % 40)) AS members FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
        JOIN embeddings ON vec_id = o_orderkey % (SELECT count(*) FROM embeddings)),
    p AS (SELECT *, dense_rank() OVER (PARTITION BY grp ORDER BY tm, o) AS k FROM ev)"""


@book.query(f"""WITH {_EV}, l AS (SELECT a.grp, a.o AS a, b.o AS b, b.k - a.k AS gap, round(list_cosine_similarity(a.v, b.v), 4) AS s, len(list_intersect(a.members, b.members)) AS shared, len(list_distinct(list_concat(a.members, b.members))) AS u
    FROM p a, (VALUES (1), (2), (3), (4), (5)) x(d) JOIN p b ON b.grp = a.grp AND b.k = a.k + x.d)
    SELECT grp, a, b, shared::int AS shared, round(shared::double / u, 4) AS jaccard, CASE WHEN gap = 1 THEN 'NEXT_EVENT' WHEN s >= 0.2 THEN 'SEMANTIC' ELSE 'ENTITY_OVERLAP' END AS edge_type
    FROM l WHERE gap = 1 OR s >= 0.2 OR round(shared::double / u, 4) >= 0.3""")
def event_link_passes(t):
    pairs = G.event_pairs(_events(t), "grp", "idx", "o", "embedding", "members", window=5)
    return G.linked(pairs, 0.2, 0.3).select("grp", "a", "b", "shared", "jaccard", "edge_type")


@book.query(f"""WITH {_EV} SELECT a.grp, a.o AS a, b.o AS b, round(len(list_intersect(a.members, b.members))::double / len(list_distinct(list_concat(a.members, b.members))), 4) AS jaccard
    FROM p a, (VALUES (1), (2)) x(d) JOIN p b ON b.grp = a.grp AND b.k = a.k + x.d WHERE round(len(list_intersect(a.members, b.members))::double / len(list_distinct(list_concat(a.members, b.members))), 4) >= 0.1""")
def micro_link_band(t):
    pairs = G.event_pairs(_events(t), "grp", "idx", "o", "embedding", "members", window=2)
    return G.linked(pairs, 2.0, 0.1, following=False).select("grp", "a", "b", "jaccard")


def _events_of_customers(t):
    return _events(t, F.col("o_custkey"), F.struct("at", "o"))


@book.query(f"""WITH {_EV.replace('o_custkey % 97 AS grp', 'o_custkey AS grp')}, l AS (SELECT a.grp, a.o AS a, b.o AS b, b.k - a.k AS gap, round(list_cosine_similarity(a.v, b.v), 4) AS s, len(list_intersect(a.members, b.members)) AS shared, len(list_distinct(list_concat(a.members, b.members))) AS u
    FROM p a JOIN p b ON a.grp = b.grp AND b.k > a.k)
    SELECT grp, a, b, s + 0.0 AS similarity, shared::int AS shared, CASE WHEN gap = 1 THEN 'NEXT_EVENT' WHEN s >= 0.2 THEN 'SEMANTIC' ELSE 'ENTITY_OVERLAP' END AS edge_type
    FROM l WHERE gap = 1 OR s >= 0.2 OR round(shared::double / u, 4) >= 0.3""")
def event_link_all_pairs(t):
    """Links among all orders of a customer, without a window and without a join of all pairs."""
    return G.event_links(_events_of_customers(t), "grp", "idx", "o", "embedding", "members", 0.2, 0.3).select("grp", "a", "b", (F.col("similarity") + 0.0).alias("similarity"), "shared", "edge_type")


@book.query(f"""WITH {_EV.replace('ORDER BY tm, o', 'ORDER BY year(tm) * 12 + month(tm)')}, l AS (SELECT a.grp, a.o AS a, b.o AS b, round(list_cosine_similarity(a.v, b.v), 4) AS s, round(len(list_intersect(a.members, b.members))::double / len(list_distinct(list_concat(a.members, b.members))), 4) AS j
    FROM p a, (VALUES (1), (2)) x(d) JOIN p b ON b.grp = a.grp AND b.k = a.k + x.d)
    SELECT grp, a, b, s + 0.0 AS similarity, CASE WHEN s >= 0.25 THEN 'SEMANTIC' ELSE 'ENTITY_OVERLAP' END AS edge_type FROM l WHERE s >= 0.25 OR j >= 0.3""")
def micro_link_passes(t):
    """Links between events of different months at most two apart: similarity first, then shared members. Events of one month are never linked."""
    events = _events(t, F.col("o_custkey") % 97, F.year("at") * 12 + F.month("at"))
    return G.tied_links(events, "grp", "idx", "o", "embedding", "members", 2, 0.25, 0.3, following=False).select("grp", "a", "b", (F.col("similarity") + 0.0).alias("similarity"), "edge_type")


@book.query(f"""WITH {_EV}, l AS (SELECT a.grp, a.o AS a, b.o AS b, b.k - a.k AS gap, round(list_cosine_similarity(a.v, b.v), 4) AS s, round(len(list_intersect(a.members, b.members))::double / len(list_distinct(list_concat(a.members, b.members))), 4) AS j
    FROM p a, (VALUES (1), (2), (3)) x(d) JOIN p b ON b.grp = a.grp AND b.k = a.k + x.d)
    SELECT grp, a, b, s AS similarity, CASE a % 3 WHEN 0 THEN 'CAUSAL' ELSE 'ENABLES' END AS edge_type FROM l WHERE gap > 1 AND s >= 0.1 AND s < 0.2 AND j < 0.3 AND a % 3 <> 1""")
def event_link_confirmed(t):
    """The fourth pass: borderline pairs that no pass linked, by verdicts that a rule stands in for."""
    from velarium.operators.kgbuild import confirmed

    # read three times, without vectors and members
    pairs = stored(G.event_pairs(_events(t), "grp", "idx", "o", "embedding", "members", window=3).select("grp", "a", "b", "pa", "pb", "similarity", "jaccard"), "pairs")
    kind = F.when(F.col("a") % 3 == 0, "CAUSAL").when(F.col("a") % 3 == 1, "UNRELATED").otherwise("ENABLES")
    verdicts = pairs.select("a", "b", kind.alias("edge_type"))
    return confirmed(pairs, G.linked(pairs, 0.2, 0.3), verdicts, 0.1, 0.2).select("grp", "a", "b", "similarity", "edge_type")


@book.query("""
    WITH e AS (SELECT o_custkey % 97 AS grp, o_orderkey AS o, epoch(o_orderdate) AS tm, l_partkey AS member FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
    m AS (SELECT p_partkey AS member, p_size % 5 AS community FROM part WHERE p_size > 33),
    v AS (SELECT grp, o, community, count(DISTINCT member) AS votes FROM e JOIN m USING (member) GROUP BY ALL),
    b AS (SELECT grp, o, first(community ORDER BY votes DESC, community) AS community, max(votes) AS shared FROM v GROUP BY ALL),
    x AS (SELECT grp, o, min(tm) AS tm FROM e GROUP BY ALL),
    y AS (SELECT x.*, community, shared FROM x LEFT JOIN b USING (grp, o)),
    z AS (SELECT *, last(CASE WHEN community IS NOT NULL THEN {'t': tm, 'c': community} END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bf,
        first(CASE WHEN community IS NOT NULL THEN {'t': tm, 'c': community} END IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS af FROM y WINDOW w AS (PARTITION BY grp ORDER BY tm, o))
    SELECT grp, o, coalesce(community, CASE WHEN af IS NULL OR tm - bf.t <= af.t - tm THEN bf.c ELSE af.c END, (SELECT min(community) FROM m))::int AS community, coalesce(shared, 0) AS shared,
        CASE WHEN community IS NOT NULL THEN 'vote' WHEN af IS NOT NULL OR bf IS NOT NULL THEN 'nearest' ELSE 'default' END AS method FROM z""")
def community_vote(t):
    orders = t("orders").select((F.col("o_custkey") % 97).alias("grp"), F.col("o_orderkey").alias("o"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("at"))
    events = orders.join(t("lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("member")), "o")
    members = t("part").filter("p_size > 33").select(F.col("p_partkey").alias("member"), (F.col("p_size") % 5).alias("community"))
    return G.community_votes(events, members, "grp", "o", F.col("at"))


@book.query()
def avg_linkage_clusters(t):
    """Average-linkage entity clusters of each label; invariants are in the tests."""
    return G.resolved_entities(t("embeddings"), "label", "vec_id", "embedding", 0.75)


def _nations(t):
    """Nations that trade: customer's and supplier's nation of each line, weighted by lines."""
    c = t("customer").select(F.col("c_custkey").alias("ck"), F.col("c_nationkey").alias("cn"))
    o = t("orders").select(F.col("o_orderkey").alias("ok"), F.col("o_custkey").alias("ck"))
    s = t("supplier").select(F.col("s_suppkey").alias("sk"), F.col("s_nationkey").alias("sn"))
    rows = t("lineitem").select(F.col("l_orderkey").alias("ok"), F.col("l_suppkey").alias("sk")).join(o, "ok").join(c, "ck").join(s, "sk")
    return G.simplified(rows.groupBy(F.col("cn").alias("src"), F.col("sn").alias("dst")).agg(F.count(F.lit(1)).cast("double").alias("weight")))


@book.query()
def communities(t):
    """Label-propagation communities of parts and suppliers; invariants are in the tests."""
    return G.communities(G.simplified(_edges(t)), 8)


@book.query("""
    WITH e AS (SELECT least(c_nationkey, s_nationkey) AS a, greatest(c_nationkey, s_nationkey) AS b, count(*)::double AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY ALL),
    m AS (SELECT n_nationkey AS node, n_regionkey AS c FROM nation), k AS (SELECT e.*, x.c AS ca, y.c AS cb FROM e JOIN m x ON x.node = a JOIN m y ON y.node = b),
    t AS (SELECT sum(w) AS m, count(*) AS n FROM k), d AS (SELECT c, sum(w) AS deg FROM (SELECT ca AS c, w FROM k UNION ALL SELECT cb, w FROM k) GROUP BY c), i AS (SELECT ca AS c, sum(CASE WHEN ca = cb THEN w ELSE 0 END) AS w_in FROM k GROUP BY ca)
    SELECT (SELECT count(*) FROM m) AS n_nodes, (SELECT count(DISTINCT c) FROM m) AS n_communities, round(sum(coalesce(w_in, 0) / t.m - pow(deg / (2 * t.m), 2)), 6) AS modularity, max(t.n) AS n_edges FROM d LEFT JOIN i USING (c), t""")
def modularity_of_regions(t):
    return G.modularity(_nations(t), t("nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("community")))


@book.query()
def random_walks(t):
    """Walks from every part and supplier; each step is an edge (tested)."""
    return G.walks(_edges(t).select("src", "dst"))


@book.query()
def node_embeddings(t):
    """Skip-gram vectors of the nodes of `random_walks`, of one epoch over all pairs."""
    return G.node_embeddings(G.walks(_edges(t).select("src", "dst")), epochs=1)


@book.query(f"""WITH e AS {_E}, b AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e), h1 AS (SELECT DISTINCT dst AS node FROM b WHERE src = -2 AND dst <> -2), h2 AS (SELECT DISTINCT dst AS node FROM b WHERE src IN (SELECT node FROM h1) AND dst <> -2),
    n AS (SELECT node, 1 AS hops FROM h1 UNION ALL SELECT node, 2 FROM h2 WHERE node NOT IN (SELECT node FROM h1))
    SELECT node, hops, round(s, 6) AS score FROM (SELECT node, hops, list_cosine_similarity(embedding::double[], [{','.join(repr(((k * 37 + 11) % 17 - 8) / 8.0) for k in range(64))}]::double[]) AS s FROM n JOIN embeddings ON vec_id = node) ORDER BY s DESC, node LIMIT 50""")
def seed_expansion(t):
    from velarium.queries.search import QUERY

    seeds = t("supplier").filter("s_suppkey = 1").select((-1 - F.col("s_suppkey")).alias("node"))
    points = t("embeddings").select(F.col("vec_id").alias("node"), "embedding")
    return G.seed_expansion(_edges(t), seeds, points, QUERY).withColumn("score", F.round("score", 6))


QUERIES, ORACLE_SQL = book.queries, book.sql
