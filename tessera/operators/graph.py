"""Registry and relationship graph: resolution, closure, contradictions, reciprocal edges, validation codes and releases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import lookup_form
from tessera.plans.registry import query, table

#: Pairs of predicates that contradict each other between the same ends.
CONTRADICTIONS = (("COMPATIBLE_WITH", "CONFLICTS_WITH"), ("SUPPORTS", "CONFLICTS_WITH"), ("REQUIRES", "CONFLICTS_WITH"), ("IS_A", "PART_OF"))
#: What a two-cycle of each predicate means.
CYCLES = {p: "forbidden" for p in ("IS_A", "PART_OF", "INITIALIZES", "UPDATES", "INSTALLED_ON", "REQUIRES", "RUNS_ON", "DEPRECATED_BY", "REPLACES")} | {p: "review" for p in ("CONFIGURES", "ENABLES", "MANAGES", "DEPENDS_ON")}


def resolve(references: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(ref_id, status, target) for ``references`` (ref_id, value, source).

    Exact canonical name, then its lookup form, exact alias, alias' lookup form; the first way with a hit counts.
    One hit resolves (rejected_self if it's the source), several are ambiguous, none unresolved.
    """
    ways = [
        (entities.select(F.col("name").alias("key"), "entity_id"), F.col("value")),
        (entities.select(lookup_form(F.col("name")).alias("key"), "entity_id"), lookup_form(F.col("value"))),
        (aliases.select(F.col("alias").alias("key"), "entity_id"), F.col("value")),
        (aliases.select(lookup_form(F.col("alias")).alias("key"), "entity_id"), lookup_form(F.col("value"))),
    ]
    hits = None
    for i, (index, key) in enumerate(ways):
        # a row for each key, so a name that many entities have meets its references once
        keys = index.groupBy("key").agg(F.countDistinct("entity_id").alias("n"), F.min("entity_id").alias("e"))
        part = references.select("ref_id", key.alias("key")).join(keys, "key").select("ref_id", F.lit(i).alias("way"), "n", "e")
        hits = part if hits is None else hits.union(part)
    first = hits.groupBy("ref_id").agg(F.min(F.struct("way", "n", "e")).alias("h"))
    status = F.when(F.col("h").isNull(), "unresolved").when(F.col("h.n") > 1, "ambiguous").when(F.col("h.e") == F.col("source"), "rejected_self").otherwise("resolved")
    return references.join(first, "ref_id", "left").select("ref_id", status.alias("status"), F.when(status == "resolved", F.col("h.e")).alias("target"), F.col("h.way").alias("way"))


def closure(edges: DataFrame, most: int = 4) -> DataFrame:
    """(src, dst, hops) of the ends of simple paths of up to ``most`` edges (src, dst): no path comes back to its beginning."""
    return reach(edges.where("src <> dst"), most).where("src <> dst")


def reach(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(src, dst, hops): what each node reaches over edges (src, dst) within ``most`` edges, or any number, and the least number it takes.

    Each round follows the pairs that the last one found first; a pair is kept once, so cycles end.
    Every round's pairs are written where ``spark.checkpoint.dir`` is set, so plans stay short.
    """
    step = edges.select(F.col("src").alias("at"), F.col("dst").alias("next")).distinct()
    new = edges.select("src", "dst", F.lit(1).alias("hops")).distinct()
    found, hops = _cut(new), 1
    new = found
    while most is None or hops < most:
        hops += 1
        ways = new.join(step, new["dst"] == step["at"]).select("src", F.col("next").alias("dst")).distinct()
        new = _cut(ways.join(found, ["src", "dst"], "left_anti").withColumn("hops", F.lit(hops)))
        if not new.take(1):
            break
        found = found.union(new)
    return found


def _cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a checkpoint, in the folder the session names or, on one machine without one, a local one."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None):
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir("/tmp/checkpoints")
    return df.checkpoint()


def rings(edges: DataFrame) -> DataFrame:
    """(node, ring, place, length) of the nodes that lie on a ring of ``edges`` (src, dst), of which each src has one; ring is the ring's smallest node, which has place 0.

    Each round doubles the steps that a node looks ahead, so there are as many rounds as the number of nodes has
    binary digits, however long chains and rings are. A node whose chain ends drops out; what others look at after as many steps as
    there are nodes lies on a ring. Places are told by the steps that are left to the ring's smallest node, doubled likewise.
    """
    ahead = _cut(edges.where("src is not null and dst is not null").select("src", "dst", F.least("src", "dst").alias("least")))
    left, steps = ahead.count(), 1
    while left and steps < left:
        further = ahead.select(F.col("src").alias("dst"), F.col("dst").alias("to"), F.col("least").alias("more"))
        ahead = _cut(ahead.join(further, "dst").select("src", F.col("to").alias("dst"), F.least("least", "more").alias("least")))
        left, steps = ahead.count(), steps * 2
    on_ring = ahead.select(F.col("dst").alias("src")).distinct()
    members = _cut(ahead.join(on_ring, "src").select("src", F.col("least").alias("ring")).join(edges.select("src", "dst"), "src"))
    root = F.col("src") == F.col("ring")
    way = members.select("src", "ring", F.when(root, F.col("ring")).otherwise(F.col("dst")).alias("dst"), F.when(root, 0).otherwise(1).alias("left"))
    while way.where("dst <> ring").take(1):
        further = way.select(F.col("src").alias("dst"), F.col("dst").alias("to"), F.col("left").alias("more"))
        way = _cut(way.join(further, "dst").select("src", "ring", F.col("to").alias("dst"), (F.col("left") + F.col("more")).alias("left")))
    lengths = way.groupBy("ring").agg(F.count("*").alias("length"))
    return way.join(lengths, "ring").select(F.col("src").alias("node"), "ring", ((F.col("length") - F.col("left")) % F.col("length")).cast("int").alias("place"), "length")


def ring_chains(found: DataFrame) -> DataFrame:
    """(ring, length, chain) of ``rings``: its nodes from the smallest back to it, ``a > b > a``."""
    nodes = F.transform(F.array_sort(F.collect_list(F.struct("place", F.col("node").cast("string").alias("node")))), lambda x: x["node"])
    return found.groupBy("ring", "length").agg(F.concat_ws(" > ", nodes, F.first("ring").cast("string")).alias("chain"))


def reciprocal(edges: DataFrame) -> DataFrame:
    """(predicate, a, b, policy) for each pair of opposite edges (src, dst, predicate), a < b."""
    policy = F.coalesce(*[F.when(F.col("predicate") == p, F.lit(v)) for p, v in CYCLES.items()], F.lit("not_applicable"))
    ends = edges.where("src <> dst").select("predicate", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), (F.col("src") < F.col("dst")).alias("up"))
    return ends.groupBy("predicate", "a", "b").agg(F.countDistinct("up").alias("n")).where("n = 2").select("predicate", "a", "b", policy.alias("policy"))


def contradictions(edges: DataFrame) -> DataFrame:
    """(src, dst, pair) where both predicates of a contradictory pair stand between the same ends."""
    sets = edges.groupBy("src", "dst").agg(F.collect_set("predicate").alias("p"))
    pairs = F.array_compact(F.array(*[F.when(F.array_contains("p", a) & F.array_contains("p", b), F.lit(f"{a}/{b}")) for a, b in CONTRADICTIONS]))
    return sets.select("src", "dst", F.explode(pairs).alias("pair"))


def endpoint_check(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with codes SOURCE_ENTITY_NOT_FOUND, TARGET_ENTITY_NOT_FOUND and SELF_RELATIONSHIP."""
    s = nodes.select(F.col("id").alias("src"), F.lit(True).alias("has_src")).distinct()
    t = nodes.select(F.col("id").alias("dst"), F.lit(True).alias("has_dst")).distinct()
    codes = F.array_compact(F.array(F.when(F.col("has_src").isNull(), "SOURCE_ENTITY_NOT_FOUND"), F.when(F.col("has_dst").isNull(), "TARGET_ENTITY_NOT_FOUND"), F.when(F.col("src") == F.col("dst"), "SELF_RELATIONSHIP")))
    return edges.join(s, "src", "left").join(t, "dst", "left").withColumn("codes", codes).drop("has_src", "has_dst")


def second_occurrences(rows: DataFrame, identity: list[str], order: list[str]) -> DataFrame:
    """Of rows that repeat an identity only the second, in order."""
    w = Window.partitionBy(*identity).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 2").drop("_n")


def diff(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, change, fields): added, removed or changed rows, with the names of changed fields."""
    a = old.select(key, F.struct(*fields).alias("o"))
    b = new.select(key, F.struct(*fields).alias("n"))
    changed = F.array_compact(F.array(*[F.when(~F.col(f"o.{f}").eqNullSafe(F.col(f"n.{f}")), F.lit(f)) for f in fields]))
    kind = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").otherwise("changed")
    both = a.join(b, key, "full").withColumn("change", kind).withColumn("fields", F.when(F.col("change") == "changed", F.array_join(changed, ",")))
    return both.where((F.col("change") != "changed") | (F.col("fields") != "")).select(key, "change", "fields")


def _parts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    part = table(spark, sf, "part")
    entities = part.select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"))
    aliases = part.where("p_size > 25").select(F.concat("p_brand", F.lit("-"), F.col("p_size").cast("string")).alias("alias"), F.col("p_partkey").alias("entity_id"))
    value = F.when(F.pmod("l_orderkey", F.lit(4)) == 0, F.upper("p_name")).when(F.pmod("l_orderkey", F.lit(4)) == 1, F.concat("p_brand", F.lit("-"), F.col("p_size").cast("string"))).when(F.pmod("l_orderkey", F.lit(4)) == 2, F.lit("unknown thing")).otherwise(F.col("p_name"))
    line = table(spark, sf, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    source = F.when(F.pmod("l_orderkey", F.lit(8)) == 3, F.col("p_partkey")).otherwise(F.lit(-1).cast("long"))
    return line.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("ref_id"), value.alias("value"), source.alias("source")).distinct(), entities, aliases


_SQL_FORM = "trim(regexp_replace(regexp_replace(regexp_replace(replace(lower(trim({0})), '_', ' '), '(\\w)-(\\w)', '\\1 \\2', 'g'), '(\\w)-(\\w)', '\\1 \\2', 'g'), '\\s+', ' ', 'g'))"
_SQL_REFS = f"""
ent AS (SELECT p_partkey AS e, p_name AS name FROM part), al AS (SELECT p_brand || '-' || p_size AS alias, p_partkey AS e FROM part WHERE p_size > 25),
refs AS (SELECT DISTINCT concat_ws('-', l_orderkey, l_linenumber, l_partkey) AS ref_id, CASE l_orderkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_brand || '-' || p_size WHEN 2 THEN 'unknown thing' ELSE p_name END AS value, CASE WHEN l_orderkey % 8 = 3 THEN p_partkey ELSE -1 END AS source FROM lineitem JOIN part ON l_partkey = p_partkey),
hits AS (SELECT ref_id, 0 AS way, e FROM refs JOIN ent ON value = name UNION ALL SELECT ref_id, 1, e FROM refs JOIN ent ON {_SQL_FORM.format('value')} = {_SQL_FORM.format('name')}
 UNION ALL SELECT ref_id, 2, e FROM refs JOIN al ON value = alias UNION ALL SELECT ref_id, 3, e FROM refs JOIN al ON {_SQL_FORM.format('value')} = {_SQL_FORM.format('alias')}),
h AS (SELECT ref_id, way, count(DISTINCT e) AS n, min(e) AS e FROM hits GROUP BY ALL), best AS (SELECT ref_id, min(way) AS way FROM h GROUP BY ref_id),
res AS (SELECT r.ref_id, CASE WHEN h.way IS NULL THEN 'unresolved' WHEN h.n > 1 THEN 'ambiguous' WHEN h.e = r.source THEN 'rejected_self' ELSE 'resolved' END AS status, h.e, h.way FROM refs r LEFT JOIN best b ON r.ref_id = b.ref_id LEFT JOIN h ON h.ref_id = b.ref_id AND h.way = b.way)"""


@query("reference_resolve", f"WITH {_SQL_REFS} SELECT ref_id, status, CASE WHEN status = 'resolved' THEN e END AS target, way FROM res")
def reference_resolve(spark: SparkSession, sf: str) -> DataFrame:
    return resolve(*_parts(spark, sf))


@query("resolution_rates", f"WITH {_SQL_REFS} SELECT status, count(*) AS n, round(count(*) * 1.0 / (SELECT count(*) FROM res), 6) AS share FROM res GROUP BY status")
def resolution_rates(spark: SparkSession, sf: str) -> DataFrame:
    found = resolve(*_parts(spark, sf)).groupBy("status").agg(F.count("*").alias("n"))
    return found.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6))  # a row for each status


@query("unresolved_groups", "SELECT lower(value) AS reference, count(*) AS occurrences, min(ref_id) AS first_ref FROM (SELECT l_orderkey AS ref_id, CASE WHEN l_orderkey % 3 = 0 THEN 'Unknown' ELSE 'OTHER' END AS value FROM lineitem) GROUP BY 1")
def unresolved_groups(spark: SparkSession, sf: str) -> DataFrame:
    refs = table(spark, sf, "lineitem").select("l_orderkey", F.when(F.col("l_orderkey") % 3 == 0, "Unknown").otherwise("OTHER").alias("value"))
    return refs.groupBy(lookup_form(F.col("value")).alias("reference")).agg(F.count("*").alias("occurrences"), F.min("l_orderkey").alias("first_ref"))


@query("duplicate_names", "SELECT p_name AS name, count(*) AS n, min(p_partkey) AS first_id FROM part GROUP BY 1 HAVING count(*) > 1")
def duplicate_names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").groupBy(F.col("p_name").alias("name")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_id")).where("n > 1")


@query("registry_diff", """
SELECT coalesce(o.k, n.k) AS p_partkey, CASE WHEN o.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'removed' ELSE 'changed' END AS change,
 CASE WHEN o.k IS NOT NULL AND n.k IS NOT NULL THEN concat_ws(',', CASE WHEN o.s <> n.s THEN 'p_size' END, CASE WHEN o.b <> n.b THEN 'p_brand' END) END AS fields
FROM (SELECT p_partkey AS k, p_size AS s, p_brand AS b FROM part WHERE p_partkey % 10 <> 1) o FULL JOIN (SELECT p_partkey AS k, CASE WHEN p_partkey % 7 = 0 THEN p_size + 1 ELSE p_size END AS s, CASE WHEN p_partkey % 5 = 0 THEN 'x' ELSE p_brand END AS b FROM part WHERE p_partkey % 10 <> 2) n ON o.k = n.k
WHERE o.k IS NULL OR n.k IS NULL OR o.s <> n.s OR o.b <> n.b""")
def registry_diff(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select("p_partkey", "p_size", "p_brand")
    new = part.where("p_partkey % 10 <> 2").withColumn("p_size", F.when(F.col("p_partkey") % 7 == 0, F.col("p_size") + 1).otherwise(F.col("p_size"))).withColumn("p_brand", F.when(F.col("p_partkey") % 5 == 0, "x").otherwise(F.col("p_brand")))
    return diff(part.where("p_partkey % 10 <> 1"), new, "p_partkey", ["p_size", "p_brand"])


@query("alias_clean", "SELECT p_brand AS alias, count(*) AS entities, min(p_partkey) AS canonical FROM part WHERE lower(p_brand) <> lower(p_name) GROUP BY 1")
def alias_clean(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").where(F.lower("p_brand") != F.lower("p_name")).groupBy(F.col("p_brand").alias("alias")).agg(F.count("*").alias("entities"), F.min("p_partkey").alias("canonical"))


def relationships(spark: SparkSession, sf: str) -> DataFrame:
    """Edges from supply: part and supplier numbers share an id space, so opposite edges and contradictions occur."""
    names = F.array(*[F.lit(p) for p in ("USES", "REQUIRES", "CONFLICTS_WITH", "SUPPORTS", "COMPATIBLE_WITH", "DEPENDS_ON", "IS_A")])
    line = table(spark, sf, "lineitem").select((F.col("l_partkey") % 60).alias("src"), (F.col("l_suppkey") % 60).alias("dst"), F.element_at(names, F.col("l_linenumber").cast("int")).alias("predicate"), "l_orderkey")
    return line


SQL_EDGES = "edges AS (SELECT l_partkey % 60 AS src, l_suppkey % 60 AS dst, ['USES', 'REQUIRES', 'CONFLICTS_WITH', 'SUPPORTS', 'COMPATIBLE_WITH', 'DEPENDS_ON', 'IS_A'][l_linenumber] AS predicate, l_orderkey FROM lineitem)"


@query("edge_dedupe", f"WITH {SQL_EDGES} SELECT src, dst, predicate, count(*) AS n, min(l_orderkey) AS first_order FROM edges GROUP BY ALL")
def edge_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    return relationships(spark, sf).groupBy("src", "dst", "predicate").agg(F.count("*").alias("n"), F.min("l_orderkey").alias("first_order"))


@query("second_duplicates", f"WITH {SQL_EDGES} SELECT src, dst, predicate, l_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY src, dst, predicate ORDER BY l_orderkey) AS n FROM edges) WHERE n = 2")
def second_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return second_occurrences(relationships(spark, sf), ["src", "dst", "predicate"], ["l_orderkey"]).select("src", "dst", "predicate", "l_orderkey")


@query("reciprocal_edges", f"""WITH {SQL_EDGES}, e AS (SELECT DISTINCT src, dst, predicate FROM edges WHERE src <> dst)
SELECT a.predicate, a.src AS a, a.dst AS b, CASE WHEN a.predicate IN ('IS_A', 'REQUIRES') THEN 'forbidden' WHEN a.predicate = 'DEPENDS_ON' THEN 'review' ELSE 'not_applicable' END AS policy FROM e a JOIN e b ON a.src = b.dst AND a.dst = b.src AND a.predicate = b.predicate WHERE a.src < a.dst""")
def reciprocal_edges(spark: SparkSession, sf: str) -> DataFrame:
    return reciprocal(relationships(spark, sf))


@query("contradictions", f"""WITH {SQL_EDGES}, e AS (SELECT DISTINCT src, dst, predicate FROM edges), p(a, b) AS (VALUES ('COMPATIBLE_WITH', 'CONFLICTS_WITH'), ('SUPPORTS', 'CONFLICTS_WITH'), ('REQUIRES', 'CONFLICTS_WITH'), ('IS_A', 'PART_OF'))
SELECT x.src, x.dst, p.a || '/' || p.b AS pair FROM p JOIN e x ON x.predicate = p.a JOIN e y ON y.predicate = p.b AND x.src = y.src AND x.dst = y.dst""")
def contradiction_sets(spark: SparkSession, sf: str) -> DataFrame:
    return contradictions(relationships(spark, sf))


@query("edge_endpoint_check", f"""WITH {SQL_EDGES}, e AS (SELECT DISTINCT src, dst FROM edges), n AS (SELECT CAST(n_nationkey AS BIGINT) AS id FROM nation)
SELECT codes, count(*) AS n FROM (SELECT concat_ws(',', CASE WHEN src NOT IN (SELECT id FROM n) THEN 'SOURCE_ENTITY_NOT_FOUND' END, CASE WHEN dst NOT IN (SELECT id FROM n) THEN 'TARGET_ENTITY_NOT_FOUND' END, CASE WHEN src = dst THEN 'SELF_RELATIONSHIP' END) AS codes FROM e) GROUP BY codes""")
def edge_endpoint_check(spark: SparkSession, sf: str) -> DataFrame:
    edges = relationships(spark, sf).select("src", "dst").distinct()
    found = endpoint_check(edges, table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id")))
    return found.groupBy(F.array_join("codes", ",").alias("codes")).agg(F.count("*").alias("n"))


_SQL_HIER = "e AS (SELECT 's' || s_suppkey AS src, 'n' || s_nationkey AS dst FROM supplier UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION SELECT 'r' || r_regionkey, 'world' FROM region)"


@query("is_a_closure", f"WITH RECURSIVE {_SQL_HIER}, w AS (SELECT src, dst, 1 AS hops FROM e UNION SELECT w.src, e.dst, w.hops + 1 FROM w JOIN e ON w.dst = e.src) SELECT src, dst, min(hops) AS hops FROM w GROUP BY ALL")
def is_a_closure(spark: SparkSession, sf: str) -> DataFrame:
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = table(spark, sf, "supplier").select(name("s", "s_suppkey").alias("src"), name("n", "s_nationkey").alias("dst"))
    edges = edges.union(table(spark, sf, "nation").select(name("n", "n_nationkey"), name("r", "n_regionkey"))).union(table(spark, sf, "region").select(name("r", "r_regionkey"), F.lit("world")))
    return reach(edges)


_SQL_DEP = "e AS (SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"


def _dependencies(spark: SparkSession, sf: str) -> DataFrame:
    """Parts depend on their suppliers, these on their nation, and nations on their region."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = table(spark, sf, "lineitem").select(name("p", "l_partkey").alias("src"), name("s", "l_suppkey").alias("dst"))
    edges = edges.union(table(spark, sf, "supplier").select(name("s", "s_suppkey"), name("n", "s_nationkey")))
    return edges.union(table(spark, sf, "nation").select(name("n", "n_nationkey"), name("r", "n_regionkey"))).distinct()


@query("dependency_paths", f"WITH RECURSIVE {_SQL_DEP}, w AS (SELECT src, dst, 1 AS hops FROM e UNION SELECT w.src, e.dst, w.hops + 1 FROM w JOIN e ON w.dst = e.src WHERE w.hops < 4) SELECT src, dst, min(hops) AS hops FROM w GROUP BY ALL")
def dependency_paths(spark: SparkSession, sf: str) -> DataFrame:
    """All dependencies over one to four edges, as the path query is bounded by four."""
    return reach(_dependencies(spark, sf), 4)


@query("risk_inheritance", f"WITH RECURSIVE {_SQL_DEP}, w AS (SELECT src, dst FROM e UNION SELECT w.src, e.dst FROM w JOIN e ON w.dst = e.src) SELECT src, greatest(length(src) % 5, max(ascii(dst) % 5 + length(dst))) AS inherited FROM w GROUP BY src")
def risk_inheritance(spark: SparkSession, sf: str) -> DataFrame:
    """The largest risk of a component and of all it depends on, over any number of edges."""
    own = F.ascii("dst") % 5 + F.length("dst")
    return reach(_dependencies(spark, sf)).groupBy("src").agg(F.greatest(F.length("src") % 5, F.max(own)).alias("inherited"))


_SQL_RING = "e AS (SELECT n_nationkey AS src, (n_nationkey + 7) % 25 AS dst FROM nation UNION SELECT n_nationkey, 25 + n_regionkey FROM nation UNION SELECT 25 + r_regionkey, 25 + r_regionkey FROM region WHERE r_regionkey = 2 UNION SELECT DISTINCT 100 + l_suppkey, l_suppkey % 25 FROM lineitem)"


@query("cycle_members", f"WITH RECURSIVE {_SQL_RING}, w AS (SELECT src, dst, 1 AS n FROM e UNION SELECT w.src, e.dst, w.n + 1 FROM w JOIN e ON w.dst = e.src WHERE w.n < 30) SELECT src AS node, min(n) AS cycle_length FROM w WHERE src = dst GROUP BY src")
def cycle_members(spark: SparkSession, sf: str) -> DataFrame:
    """Members of cycles of any length: nations in a ring of 25, a region that depends on itself, and others that only lead there."""
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    edges = nation.select(F.col("n_nationkey").alias("src"), ((F.col("n_nationkey") + 7) % 25).alias("dst")).union(nation.select("n_nationkey", F.col("n_regionkey") + 25))
    edges = edges.union(region.where("r_regionkey = 2").select(F.col("r_regionkey") + 25, F.col("r_regionkey") + 25))
    return cycles(edges.union(table(spark, sf, "lineitem").select(F.col("l_suppkey") + 100, F.col("l_suppkey") % 25).distinct()))


def cycles(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(node, cycle_length): nodes that reach themselves, with the shortest way, over cycles of up to ``most`` edges, or any length."""
    return reach(edges, most).where("src = dst").select(F.col("src").alias("node"), F.col("hops").alias("cycle_length"))


@query("orphan_rules", "SELECT o_orderkey AS rule_id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def orphan_rules(spark: SparkSession, sf: str) -> DataFrame:
    orders, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select(F.col("o_orderkey").alias("rule_id"))


@query("one_hop_neighbours", "SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def one_hop_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    s, n, r = (table(spark, sf, t) for t in ("supplier", "nation", "region"))
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "n_name", "r_name")


@query("undirected_degree", f"WITH {SQL_EDGES}, u AS (SELECT src AS n, dst AS m FROM edges UNION SELECT dst, src FROM edges) SELECT n AS node, count(*) AS neighbours FROM u WHERE n <> m GROUP BY n")
def undirected_degree(spark: SparkSession, sf: str) -> DataFrame:
    e = relationships(spark, sf).select("src", "dst")
    both = e.union(e.select("dst", "src")).distinct().where("src <> dst")
    return both.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("neighbours"))


@query("gap_grouping_sets", f"WITH {SQL_EDGES} SELECT predicate, side, count(*) AS n FROM (SELECT predicate, CASE WHEN src < dst THEN 'up' ELSE 'down' END AS side FROM edges) GROUP BY GROUPING SETS ((predicate), (side), ())")
def gap_grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    e = relationships(spark, sf).select("predicate", F.when(F.col("src") < F.col("dst"), "up").otherwise("down").alias("side"))
    return e.groupingSets([[F.col("predicate")], [F.col("side")], []], "predicate", "side").agg(F.count("*").alias("n")).select("predicate", "side", "n")


@query("category_routing", "SELECT CASE WHEN a.p_type = b.p_type THEN split_part(a.p_type, ' ', 1) ELSE 'cross_domain' END AS route, count(*) AS n FROM lineitem JOIN part a ON l_partkey = a.p_partkey JOIN part b ON l_partkey % 100 + 1 = b.p_partkey GROUP BY 1")
def category_routing(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select("p_partkey", "p_type")
    line = table(spark, sf, "lineitem").select("l_partkey", (F.col("l_partkey") % 100 + 1).alias("other"))
    both = line.join(part.withColumnRenamed("p_type", "a"), F.col("l_partkey") == F.col("p_partkey")).drop("p_partkey").join(part.withColumnRenamed("p_type", "b"), F.col("other") == F.col("p_partkey"))
    route = F.when(F.col("a") == F.col("b"), F.element_at(F.split("a", " "), 1)).otherwise("cross_domain")
    return both.groupBy(route.alias("route")).agg(F.count("*").alias("n"))


@query("stable_relationship_ids", f"WITH {SQL_EDGES} SELECT 'REL-' || upper(substring(sha256(src || '|' || predicate || '|' || dst), 1, 12)) AS rel_id, count(*) AS n FROM edges GROUP BY 1")
def stable_relationship_ids(spark: SparkSession, sf: str) -> DataFrame:
    rid = F.concat(F.lit("REL-"), F.upper(F.substring(F.sha2(F.concat_ws("|", "src", "predicate", "dst"), 256), 1, 12)))
    return relationships(spark, sf).groupBy(rid.alias("rel_id")).agg(F.count("*").alias("n"))


@query("lifecycle_transitions", """
WITH l AS (SELECT user_id, event_type AS b, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a FROM events)
SELECT a AS from_state, b AS to_state, (a, b) IN (('view', 'click'), ('click', 'purchase'), ('signup', 'view')) AS allowed, count(*) AS n FROM l WHERE a IS NOT NULL GROUP BY ALL""")
def lifecycle_transitions(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = table(spark, sf, "events").select(F.lag("event_type").over(w).alias("from_state"), F.col("event_type").alias("to_state")).where("from_state IS NOT NULL")
    allowed = spark.createDataFrame([("view", "click", True), ("click", "purchase", True), ("signup", "view", True)], "from_state string, to_state string, allowed boolean")
    return steps.join(F.broadcast(allowed), ["from_state", "to_state"], "left").groupBy("from_state", "to_state", F.coalesce("allowed", F.lit(False)).alias("allowed")).agg(F.count("*").alias("n"))


@query("release_gates", """
SELECT gate, ok, CASE WHEN bool_and(ok) OVER () THEN 'READY' ELSE 'BLOCKED' END AS release FROM (SELECT 'unique_orders' AS gate, count(*) = count(DISTINCT o_orderkey) AS ok FROM orders UNION ALL SELECT 'no_negative_price', count(*) FILTER (o_totalprice < 0) = 0 FROM orders
UNION ALL SELECT 'known_customers', count(*) = 0 FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'no_open', count(*) FILTER (o_orderstatus = 'O') = 0 FROM orders)""")
def release_gates(spark: SparkSession, sf: str) -> DataFrame:
    orders, customers = table(spark, sf, "orders"), table(spark, sf, "customer")
    unknown = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"), "left_anti").agg((F.count("*") == 0).alias("known_customers"))
    one = orders.agg((F.count("*") == F.countDistinct("o_orderkey")).alias("unique_orders"), (F.count(F.when(F.col("o_totalprice") < 0, 1)) == 0).alias("no_negative_price"), (F.count(F.when(F.col("o_orderstatus") == "O", 1)) == 0).alias("no_open"))
    checks = one.join(F.broadcast(unknown), F.lit(True))  # two single rows
    gates = checks.unpivot([], ["unique_orders", "no_negative_price", "known_customers", "no_open"], "gate", "ok")
    return gates.withColumn("release", F.when(F.bool_and("ok").over(Window.partitionBy(F.lit(1))), "READY").otherwise("BLOCKED"))


@query("lineage_difference", "SELECT (SELECT count(*) FROM (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem)) AS missing, (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem EXCEPT SELECT o_orderkey FROM orders)) AS unexpected")
def lineage_difference(spark: SparkSession, sf: str) -> DataFrame:
    a, b = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k")), table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"))
    return a.subtract(b).agg(F.count("*").alias("missing")).join(F.broadcast(b.subtract(a).agg(F.count("*").alias("unexpected"))), F.lit(True))  # two single rows
