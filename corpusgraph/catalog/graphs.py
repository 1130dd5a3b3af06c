"""Graph, hierarchy and graph-summary queries."""

from pyspark.sql import functions as F

from corpusgraph.catalog.fixtures import query
from corpusgraph.operators import graph as G
from corpusgraph.operators import hierarchy as H
from corpusgraph.plans.loops import cut


def _named(**columns: str) -> str:
    """SQL columns from ids that name their project: the project of the first, then the id of each."""
    first = next(iter(columns.values()))
    ids = ", ".join(f"substr({x}, instr({x}, '|') + 1) AS {name}" for name, x in columns.items())
    return f"CAST(split_part({first}, '|', 1) AS BIGINT) AS project, {ids}"


@query("g4_reverse_adjacency", """
    SELECT n.project, n.id, d.src AS dependent FROM $F_nodes n LEFT JOIN (SELECT DISTINCT project, src, dst FROM $F_deps) d
      ON d.dst = n.id AND d.project = n.project""")
def _(t):
    return G.dependents(t("F_nodes"), t("F_deps"))


@query("g5_forward_adjacency", "SELECT DISTINCT project, src AS id, dst AS dependency FROM $F_deps")
def _(t):
    return G.dependencies(t("F_deps"))


@query("g6_edges_from_adjacency", """
    SELECT project, src, dst, 'import' AS kind FROM (SELECT DISTINCT project, src, dst FROM $F_deps WHERE src LIKE 'src/%') d""")
def _(t):
    # A file has few dependencies, so its array is short; hubs are on the other side.
    adjacency = G.dependencies(t("F_deps")).groupBy("project", "id").agg(F.array_sort(F.collect_set("dependency")).alias("depends_on"))
    return G.edges_from_adjacency(adjacency)


@query("g7_dangling_edges", f"""
    SELECT {_named(src="src", dst="dst")}, kind FROM $F_kdeps
    WHERE src NOT IN (SELECT id FROM $F_knodes) OR dst NOT IN (SELECT id FROM $F_knodes)""")
def _(t):
    return G.dangling(t("F_nodes"), t("F_deps"))


_FORWARD = """WITH RECURSIVE links AS (SELECT DISTINCT src, dst FROM $F_kdeps),
    reach(seed, id) AS (SELECT id, id FROM $F_knodes UNION SELECT r.seed, l.dst FROM reach r JOIN links l ON l.src = r.id)"""


def _per_seed(pairs):
    return pairs.groupBy("project", "seed").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query("g8_forward_closure", _FORWARD + f"""
    SELECT {_named(seed="seed", first_id="min(id)", last_id="max(id)")}, count(*) AS n FROM reach GROUP BY seed""")
def _(t):
    return _per_seed(G.reachable(t("F_nodes").select("project", "id"), t("F_deps")))


@query("g9_reverse_closure", f"""
    WITH RECURSIVE links AS (SELECT DISTINCT dst AS src, src AS dst FROM $F_kdeps),
    reach(seed, id) AS (SELECT id, id FROM $F_knodes UNION SELECT r.seed, l.dst FROM reach r JOIN links l ON l.src = r.id)
    SELECT {_named(seed="seed", first_id="min(id)", last_id="max(id)")}, count(*) AS n FROM reach WHERE id <> seed GROUP BY seed""")
def _(t):
    return _per_seed(G.transitive_dependents(t("F_nodes").select("project", "id"), t("F_nodes"), t("F_deps")))


@query("g10_neighbourhood", f"""
    WITH RECURSIVE links AS (SELECT DISTINCT a, b FROM (SELECT src AS a, dst AS b FROM $F_kdeps UNION ALL SELECT dst, src FROM $F_kdeps) u
      WHERE a IN (SELECT id FROM $F_knodes) AND b IN (SELECT id FROM $F_knodes)),
    one AS (SELECT id AS focus, id, 0 AS distance FROM $F_knodes UNION ALL SELECT a, b, 1 FROM links WHERE a <> b),
    two AS (SELECT focus, id, distance FROM one UNION ALL SELECT DISTINCT o.focus, l.b, 2 FROM one o JOIN links l ON l.a = o.id WHERE o.distance = 1),
    best AS (SELECT focus, id, min(distance) AS distance FROM two GROUP BY focus, id)
    SELECT {_named(focus="focus", first_id="min(id)")}, distance, count(*) AS n FROM best GROUP BY focus, distance""")
def _(t):
    nodes = cut(t("F_nodes").select("project", "id"))
    near = G.neighbourhood(nodes, t("F_deps"), nodes, 2)
    return near.groupBy("project", "focus", "distance").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query("g11_induced_subgraph", f"""
    WITH keep AS (SELECT id FROM $F_knodes WHERE engine = 'js')
    SELECT {_named(src="src", dst="dst")}, kind FROM $F_kdeps WHERE src IN (SELECT id FROM keep) AND dst IN (SELECT id FROM keep)""")
def _(t):
    return G.induced(t("F_deps"), t("F_nodes").filter("engine = 'js'")).select("project", "src", "dst", "kind")


_ORPHANS = """links AS (SELECT DISTINCT src, dst FROM $F_kdeps WHERE src <> dst AND src IN (SELECT id FROM $F_knodes)),
    roots AS (SELECT id FROM $F_knodes WHERE id NOT IN (SELECT dst FROM links)),
    reach(id, hit) AS (SELECT id, false FROM roots UNION SELECT l.dst, true FROM reach r JOIN links l ON l.src = r.id),
    orphan AS (SELECT project, id, CASE WHEN id IN (SELECT src FROM $F_kdeps) THEN 'entry_point'
      WHEN type = 'asset' THEN 'unreferenced_asset' ELSE 'unreferenced' END AS reason
      FROM $F_knodes WHERE id NOT IN (SELECT id FROM reach WHERE hit))"""


@query("g12_orphans", f"""WITH RECURSIVE {_ORPHANS} SELECT {_named(id="id")}, reason FROM orphan""")
def _(t):
    return G.orphans(t("F_nodes"), t("F_deps"))


@query("g13_cycle_groups", f"""
    WITH RECURSIVE links AS (SELECT DISTINCT src, dst FROM $F_kdeps WHERE contains(dst, '|src/')),
    reach(seed, id) AS (SELECT src, dst FROM links UNION SELECT r.seed, l.dst FROM reach r JOIN links l ON l.src = r.id),
    on_cycle AS (SELECT seed AS id FROM reach WHERE seed = id)
    SELECT {_named(id="a.seed", cycle="min(a.id)")} FROM reach a JOIN reach b ON b.seed = a.id AND b.id = a.seed
    WHERE a.seed IN (SELECT id FROM on_cycle) GROUP BY a.seed""")
def _(t):
    return G.cycle_groups(t("F_deps"))


_LAYERS = """links AS (SELECT DISTINCT src, dst FROM $F_kdeps WHERE src IN (SELECT id FROM $F_knodes) AND dst IN (SELECT id FROM $F_knodes)),
    reach(seed, id) AS (SELECT src, dst FROM links UNION SELECT r.seed, l.dst FROM reach r JOIN links l ON l.src = r.id),
    cyc AS (SELECT DISTINCT seed AS id FROM reach WHERE seed = id),
    blocked AS (SELECT id FROM cyc UNION SELECT seed FROM reach WHERE id IN (SELECT id FROM cyc)),
    free AS (SELECT id FROM $F_knodes WHERE id NOT IN (SELECT id FROM blocked)),
    depth(id, layer) AS (SELECT id, 0 FROM free WHERE id NOT IN (SELECT src FROM links)
      UNION SELECT l.src, d.layer + 1 FROM depth d JOIN links l ON l.dst = d.id WHERE l.src IN (SELECT id FROM free)),
    placed AS (SELECT n.project, n.id, max(d.layer) AS layer FROM $F_knodes n LEFT JOIN depth d ON d.id = n.id GROUP BY n.project, n.id)"""


@query("g14_topological_layers", f"""WITH RECURSIVE {_LAYERS} SELECT {_named(id="id")}, layer FROM placed""")
def _(t):
    return G.layers(t("F_nodes"), t("F_deps"))


@query("g15_sorted_edges", "SELECT src, dst, kind FROM $F_deps ORDER BY src, dst, kind")
def _(t):
    return G.sorted_edges(t("F_deps")).select("src", "dst", "kind")


@query("g16_fingerprint", """
    SELECT sha256('n|' || id || '|' || type || '|' || engine) AS digest FROM $F_nodes
    UNION ALL SELECT sha256('e|' || src || '|' || dst || '|' || kind) FROM $F_deps""")
def _(t):
    return G.row_fingerprints(t("F_nodes"), t("F_deps"))


@query("g16_same_extraction", """
    SELECT 'equal' AS side, count(*) AS n FROM (SELECT id FROM $F_nodes UNION ALL SELECT src FROM $F_deps) u
    UNION ALL SELECT 'right', count(*) FROM $F_deps WHERE kind = 'signal_connection'""")
def _(t):
    # the extraction is stored once, and once more in another order; digests, which are longer, are made again when they are read
    nodes, edges = cut(t("F_nodes").select("id", "type", "engine")), cut(t("F_deps").select("src", "dst", "kind"))
    mixed_nodes, mixed_edges = cut(nodes.orderBy(F.col("id").desc())), cut(edges.repartition(5))
    left, shuffled = G.row_fingerprints(nodes, edges), G.row_fingerprints(mixed_nodes, mixed_edges)
    fewer = G.row_fingerprints(nodes, edges.filter("kind <> 'signal_connection'"))
    both = G.fingerprint(nodes, edges).intersect(G.fingerprint(mixed_nodes, mixed_edges))
    equal = both.select(F.lit("equal").alias("side"), F.col("rows").alias("n"))
    return equal.unionByName(G.same_graph(G.tally(fewer), G.in_both(left, shuffled)).groupBy("side").agg(F.sum("n").alias("n")))


@query("a1_graph_summary", f"""WITH RECURSIVE {_ORPHANS}
    SELECT project, 'nodes' AS metric, '' AS key, count(*) AS n FROM $F_nodes GROUP BY project
    UNION ALL SELECT project, 'edges', '', count(*) FROM $F_deps GROUP BY project
    UNION ALL SELECT project, 'orphans', '', count(*) FROM orphan GROUP BY project
    UNION ALL SELECT project, 'type', type, count(*) FROM $F_nodes GROUP BY project, type
    UNION ALL SELECT project, 'kind', kind, count(*) FROM $F_deps GROUP BY project, kind""")
def _(t):
    return G.summary(t("F_nodes"), t("F_deps"))


@query("a2_frequency_text", """
    SELECT string_agg(kind || ' (' || CAST(n AS STRING) || ')', ', ' ORDER BY n DESC, kind) AS text FROM (
      SELECT kind, count(*) AS n FROM $F_deps GROUP BY kind) k""")
def _(t):
    return G.frequency_text(t("F_deps"), "kind")


@query("a5_graph_section", f"""WITH RECURSIVE {_LAYERS}
    SELECT project, 'nodes' AS metric, count(*) AS n FROM $F_nodes GROUP BY project
    UNION ALL SELECT project, 'edges', count(*) FROM $F_deps GROUP BY project
    UNION ALL SELECT project, 'layers', coalesce(max(layer) + 1, 0) FROM placed GROUP BY project
    UNION ALL SELECT project, 'cyclic', count(*) FROM placed WHERE layer IS NULL GROUP BY project
    UNION ALL SELECT project, 'dangling', count(*) FROM $F_kdeps
      WHERE src NOT IN (SELECT id FROM $F_knodes) OR dst NOT IN (SELECT id FROM $F_knodes) GROUP BY project
    UNION ALL SELECT project, 'layer ' || CAST(layer AS STRING), count(*) FROM placed WHERE layer IS NOT NULL GROUP BY project, layer""")
def _(t):
    return G.section_counts(t("F_nodes"), t("F_deps"))


@query("u2_unplaced_nodes", f"""WITH RECURSIVE {_LAYERS} SELECT {_named(id="id")} FROM placed WHERE layer IS NULL""")
def _(t):
    placed = G.layers(t("F_nodes"), t("F_deps")).filter("layer IS NOT NULL")
    return t("F_nodes").select("project", "id").join(placed.select("project", "id"), ["project", "id"], "left_anti")


@query("u4_distinct_edges", "SELECT DISTINCT project, src, dst, kind FROM $F_deps")
def _(t):
    edges = t("F_deps").select("project", "src", "dst", "kind")
    return edges.unionByName(edges).dropDuplicates(["project", "src", "dst", "kind"])


# --- hierarchies -------------------------------------------------------------

_TREE = """clean AS (SELECT id, name, prefab, CASE WHEN parent <> id AND parent IN (SELECT id FROM $F_tree) THEN parent END AS up,
      parent IS NOT NULL AS named FROM $F_tree),
    walk(id, cur) AS (SELECT id, up FROM clean WHERE up IS NOT NULL UNION
      SELECT w.id, c.up FROM walk w JOIN clean c ON c.id = w.cur WHERE c.up IS NOT NULL),
    on_cycle AS (SELECT id FROM walk WHERE id = cur),
    opened AS (SELECT o.id FROM on_cycle o JOIN walk w ON w.id = o.id JOIN on_cycle p ON p.id = w.cur GROUP BY o.id HAVING min(p.id) = o.id),
    cut AS (SELECT id, name, prefab, CASE WHEN id IN (SELECT id FROM opened) THEN NULL ELSE up END AS up,
      named AND (up IS NULL OR id IN (SELECT id FROM opened)) AS orphan FROM clean),
    tree(id, root, depth, order_key) AS (
      SELECT id, id, 0, lpad(CAST(id AS STRING), 12, '0') FROM cut WHERE up IS NULL
      UNION ALL SELECT c.id, t.root, t.depth + 1, t.order_key || '/' || lpad(CAST(c.id AS STRING), 12, '0')
      FROM tree t JOIN cut c ON c.up = t.id),
    anc(id, ancestor) AS (SELECT id, up FROM cut WHERE up IS NOT NULL UNION ALL
      SELECT a.id, c.up FROM anc a JOIN cut c ON c.id = a.ancestor WHERE c.up IS NOT NULL)"""


@query("g17_hierarchy", f"""WITH RECURSIVE {_TREE}
    SELECT t.id, c.up AS parent, t.root, t.depth, c.orphan FROM tree t JOIN cut c ON c.id = t.id""")
def _(t):
    return H.build_tree(t("F_tree")).select("id", "parent", "root", "depth", "orphan")


@query("g18_subtree_sizes", f"""WITH RECURSIVE {_TREE}
    SELECT t.id, 1 + (SELECT count(*) FROM anc WHERE ancestor = t.id) AS subtree,
      (SELECT count(*) FROM cut WHERE up = t.id) AS children FROM tree t""")
def _(t):
    return H.subtree_sizes(H.build_tree(t("F_tree")))


@query("g19_hierarchy_filter", f"""WITH RECURSIVE {_TREE},
    hit AS (SELECT id FROM cut WHERE contains(CAST(id AS STRING), '77') OR contains(lower(name), '77') OR contains(lower(prefab), '77'))
    SELECT id, CASE min(r) WHEN 0 THEN 'match' WHEN 1 THEN 'descendant' ELSE 'ancestor' END AS reason FROM (
      SELECT id, 0 AS r FROM hit UNION ALL SELECT ancestor, 1 FROM anc WHERE id IN (SELECT id FROM hit)
      UNION ALL SELECT id, 2 FROM anc WHERE ancestor IN (SELECT id FROM hit)) u GROUP BY id""")
def _(t):
    return H.filter_tree(H.build_tree(t("F_tree")), t("F_tree"), " 77 ")


@query("g20_hierarchy_flatten", f"""WITH RECURSIVE {_TREE}
    SELECT id, depth, row_number() OVER (ORDER BY order_key) - 1 AS order_key FROM tree""")
def _(t):
    return H.flatten(H.build_tree(t("F_tree"))).orderBy("order_key")


@query("g21_parent_cycles", f"""WITH RECURSIVE {_TREE}
    SELECT DISTINCT id FROM walk WHERE cur IN (SELECT id FROM on_cycle)""")
def _(t):
    return H.cycle_members(t("F_tree"))
