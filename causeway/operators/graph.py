"""Typed dependency graphs: checks, bounded simple paths, scores, reachability and convergence.

A graph is a DataFrame of edges ``source, target, kind``. Paths grow by one self-join per hop, so that Catalyst plans each hop by the
frontier's size; reachability keeps distinct nodes per step and never counts paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.storage import materialize

# Weight of an edge by its kind, and of a kind not listed.
WEIGHTS = {"DB_WRITE": 1.0, "DB_READ": 0.9, "API_CONSUMES": 0.85, "HTTP_CALL": 0.75, "CONFIG_DEPENDENCY": 0.7, "CALL": 0.6, "IMPORT": 0.35}
OTHER_WEIGHT = 0.5
#: Slots in which edges are counted by a hash of their source, and edges of a slot whose sources are dealt by bucket.
SLOTS, HUB = 65_536, 1_000_000
#: Shares of a node's edges, each of which is aggregated by itself before they meet.
SALTS = 8


def dealt(df: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` into ``parts`` partitions, so that what a task holds doesn't grow with the table; without ``parts``, as Spark deals it."""
    return df.repartition(parts, *keys) if parts else df


def weight(kind: Column) -> Column:
    out = F.lit(OTHER_WEIGHT)
    for name, value in WEIGHTS.items():
        out = F.when(kind == name, value).otherwise(out)
    return out


def severity(product: Column, hops: Column) -> Column:
    return F.bround(product / (1 + 0.5 * (hops - 1)), 6)


def severity_level(score: Column) -> Column:
    return F.when(score >= 0.9, "CRITICAL").when(score >= 0.7, "HIGH").when(score >= 0.45, "MEDIUM").otherwise("LOW")


def collapse(edges: DataFrame, parts: int | None = None) -> DataFrame:
    """One edge per pair of nodes: that of the greatest kind."""
    return dealt(edges, parts, "source", "target").groupBy("source", "target").agg(F.max("kind").alias("kind"))


def dangling(entities: DataFrame, edges: DataFrame, parts: int | None = None) -> DataFrame:
    """Edge ends that no entity has."""
    # a node's ends are shared out first, so that no hub's come to one task
    ends = edges.select(F.explode(F.array("source", "target")).alias("entity_id"), F.pmod(F.xxhash64("source", "target"), F.lit(SALTS)).alias("salt"))
    ends = dealt(ends, parts, "entity_id", "salt").distinct()
    return dealt(ends.select("entity_id"), parts, "entity_id").distinct().join(dealt(entities.select("entity_id"), parts, "entity_id"), "entity_id", "left_anti")


def duplicate_entities(entities: DataFrame) -> DataFrame:
    return entities.groupBy("entity_id").agg(F.count("*").alias("n")).filter("n > 1")


def duplicate_edges(edges: DataFrame, parts: int | None = None) -> DataFrame:
    return dealt(edges, parts, "source", "target", "kind").groupBy("source", "target", "kind").agg(F.count("*").alias("n")).filter("n > 1")


def self_loops(edges: DataFrame) -> DataFrame:
    return edges.filter("source = target")


def kind_histogram(edges: DataFrame) -> DataFrame:
    return edges.groupBy("kind").agg(F.count("*").alias("n_edges"))


def _grow(front: DataFrame, edges: DataFrame, hop: int, parts: int | None = None) -> DataFrame:
    """The paths of ``front``, each longer by an edge; written, so that the next hop's join is planned by their true size.

    Parallel edges are collapsed (as by ``collapse``) only after they met the paths, so that the edge table itself is never dealt or
    written as a whole when few paths grow.
    """
    near = front.join(edges.select("source", "target", "kind"), F.element_at("nodes", -1) == F.col("source")).filter(~F.array_contains("nodes", F.col("target")))
    near = dealt(near, parts, "nodes", "target").groupBy("origin", "nodes", "kinds", "product", "target").agg(F.max("kind").alias("kind"))
    return materialize(near.select("origin", F.array_append("nodes", F.col("target")).alias("nodes"), F.array_append("kinds", F.col("kind")).alias("kinds"), (F.col("product") * weight(F.col("kind"))).alias("product"), F.lit(hop).alias("hops")), f"paths{hop}")


def _start(origins: DataFrame) -> DataFrame:
    return origins.select("origin", F.array("origin").alias("nodes"), F.array().cast("array<string>").alias("kinds"), F.lit(1.0).alias("product"))


def paths(edges: DataFrame, origins: DataFrame, max_hops: int | None, enough: int | None = None, parts: int | None = None) -> DataFrame:
    """All simple paths of 1 to ``max_hops`` edges from ``origins`` (origin): ``origin, nodes, kinds, product, hops``.

    Without ``max_hops``, of any length, until no path grows: for small or acyclic graphs. Origins that have ``enough`` paths after a
    hop go no further, since longer paths come after them.
    """
    front, found, hop = _start(origins), None, 0
    while max_hops is None or hop < max_hops:
        hop += 1
        front = _grow(front, edges, hop, parts)
        found = front if found is None else found.unionByName(front)
        if enough is not None and hop != max_hops:
            full = found.groupBy("origin").agg(F.count("*").alias("n")).filter(F.col("n") >= enough)
            front = front.join(full, "origin", "left_anti")
        if front.isEmpty():
            break
    return found


def all_paths(edges: DataFrame, origins: DataFrame) -> DataFrame:
    """All simple paths, of any length."""
    return paths(edges, origins, None)


def first_paths(found: DataFrame, max_paths: int, parts: int | None = None) -> DataFrame:
    """Of each origin the first ``max_paths`` by length, then by nodes."""
    place = F.row_number().over(Window.partitionBy("origin").orderBy("hops", "nodes"))
    return dealt(found, parts, "origin").withColumn("place", place).filter(F.col("place") <= max_paths).drop("place")


def findings(found: DataFrame) -> DataFrame:
    """Paths as findings with score, level, category and reason."""
    score = severity(F.col("product"), F.col("hops"))
    return found.select("origin", F.element_at("nodes", -1).alias("entity"), "hops", F.concat_ws(">", "nodes").alias("path"), score.alias("severity"), severity_level(score).alias("level"), F.when(F.col("hops") == 1, "DIRECT").otherwise("INDIRECT").alias("category"), F.concat_ws(" -> ", "kinds").alias("reason"))


def blast_radius(edges: DataFrame, origins: DataFrame, max_hops: int = 3, max_paths: int = 100, parts: int | None = None) -> DataFrame:
    """Findings of every origin: paths cut by length and nodes first, then scored. ``parts`` is for many origins, whose paths are many."""
    return findings(first_paths(paths(edges, origins, max_hops, max_paths, parts), max_paths, parts))


def impact_summary(found: DataFrame) -> DataFrame:
    """Of each origin: distinct entities reached directly, indirectly and at all."""
    direct = F.col("category") == "DIRECT"
    return found.groupBy("origin").agg(F.count_distinct(F.when(direct, F.col("entity"))).alias("direct"), F.count_distinct(F.when(~direct, F.col("entity"))).alias("indirect"), F.count_distinct("entity").alias("affected"), F.max("severity").alias("max_severity"))


def merged_summary(found: DataFrame) -> DataFrame:
    """Over all origins: direct and indirect findings, distinct entities."""
    return found.agg(F.count_if(F.col("category") == "DIRECT").alias("direct"), F.count_if(F.col("category") == "INDIRECT").alias("indirect"), F.count_distinct("entity").alias("affected"))


def convergence(found: DataFrame) -> DataFrame:
    """Entities that two origins or more reach."""
    return found.groupBy("entity").agg(F.array_sort(F.collect_set("origin")).alias("o")).filter(F.size("o") >= 2).select("entity", F.concat_ws(",", "o").alias("origins"), F.size("o").alias("n_origins"))


def reachable(edges: DataFrame, origins: DataFrame, max_hops: int | None = None) -> DataFrame:
    """``node, hop`` of every node that the origins reach, with the least number of hops; origins themselves have hop 0."""
    seen = front = materialize(origins.select(F.col("origin").alias("node"), F.lit(0).alias("hop")).distinct(), "front")
    hop = 0
    while max_hops is None or hop < max_hops:
        hop += 1
        near = front.join(edges.select("source", "target"), F.col("node") == F.col("source")).select(F.col("target").alias("node")).distinct()
        front = materialize(near.join(seen, "node", "left_anti").select("node", F.lit(hop).alias("hop")), f"front{hop}")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("target").alias("source"), F.col("source").alias("target"), "kind")


def canonical_path(edges: DataFrame, origins: DataFrame, terminal: str, max_hops: int) -> DataFrame:
    """The shortest path of each origin to ``terminal``, the first by nodes among equals.

    Each step keeps one path per origin and node reached for the first time, the first by nodes: a shortest path's beginnings are shortest
    paths themselves, so no other can become the first.
    """
    front = materialize(origins.select("origin", F.col("origin").alias("node"), F.array("origin").alias("nodes")).distinct(), "first0")
    seen = front.select("origin", "node")
    found = front.limit(0)
    for hop in range(1, max_hops + 1):
        grown = front.join(edges.select("source", "target"), front["node"] == F.col("source")).groupBy("origin", F.col("target").alias("node")).agg(F.min("nodes").alias("nodes"))
        fresh = grown.join(seen, ["origin", "node"], "left_anti").select("origin", "node", F.array_append("nodes", F.col("node")).alias("nodes"))
        fresh = materialize(fresh, f"first{hop}")
        here = fresh.filter(F.col("node") == terminal)
        found = found.unionByName(here)
        # origins that arrived are done
        front = fresh.join(here.select("origin"), "origin", "left_anti")
        seen = seen.unionByName(fresh.select("origin", "node"))
        if front.isEmpty():
            break
    return found.select("origin", (F.size("nodes") - 1).alias("hops"), F.concat_ws(">", "nodes").alias("path"))


def correlate(entities: DataFrame, objects: DataFrame) -> DataFrame:
    """Entities of schema objects: of the very id, else all whose first dotted part is the object's table."""
    exact = objects.join(entities, objects["object"] == entities["entity_id"]).select("object", "entity_id")
    rest = objects.join(exact.select("object").distinct(), "object", "left_anti")
    table = entities.withColumn("table", F.substring_index("entity_id", ".", 1))
    return exact.unionByName(rest.join(table, F.substring_index("object", ".", 1) == F.col("table")).select("object", "entity_id"))


def adjacency_digest(edges: DataFrame, parts: int | None = None, repeats: bool = False) -> DataFrame:
    """Of each source a digest of its edges: their hashes joined in order within buckets, then those of the buckets. With ``repeats``, edges that repeat count once.

    Edges are dealt by source once, as they are, and hashed where they arrive. Sources of many edges are dealt by bucket, so that hubs are
    shared out: they are found by counting all edges in slots, of which one that holds a hub has more than ``HUB``.
    """
    slot = F.pmod(F.xxhash64("source"), F.lit(SLOTS))
    full = materialize(edges.groupBy(slot.alias("slot")).agg(F.count("*").alias("n")).filter(F.col("n") > HUB).select("slot"), "hubs")
    gather = F.collect_set if repeats else F.collect_list

    def joined(values: Column) -> Column:
        return F.sha2(F.array_join(F.array_sort(values), ","), 256)

    def digests(own: DataFrame) -> DataFrame:
        each = own.withColumn("h", F.sha2(F.concat_ws(":", "target", "kind"), 256))
        return each.groupBy("source", F.substring("h", 1, 4).alias("b")).agg(joined(gather("h")).alias("h")).groupBy("source").agg(joined(F.collect_list("h")).alias("edges_sha256"))

    some = edges.select("source", "target", "kind").withColumn("slot", slot)
    return digests(dealt(some.join(full, "slot", "left_anti"), parts, "source")).unionByName(digests(some.join(full, "slot", "left_semi")))


def scored_edges(edges: DataFrame, parts: int | None = None) -> DataFrame:
    """Every collapsed edge with the score and level of a direct impact over it."""
    score = severity(weight(F.col("kind")), F.lit(1))
    return collapse(edges, parts).select("source", "target", score.alias("severity"), severity_level(score).alias("level"))


def last_written(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per ``keys``: the one written last. Needs no sort of what is under a key."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def first_written(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def merge_evidence(items: DataFrame, order: str) -> DataFrame:
    """Evidence of edges (source, target, kind) without repeats of place, pattern and value; of repeats the last counts."""
    return last_written(items, ["source", "target", "kind", "source_file", "line", "matched_pattern", "extracted_value"], order)


def evidence_count(items: DataFrame) -> DataFrame:
    return items.groupBy("source", "target", "kind").agg(F.count("*").alias("n_evidence"))


def evidence_total(rows: DataFrame, provenance: str = "provenance") -> DataFrame:
    """One row ``n_evidence``: how many pieces of evidence all rows hold; a null list holds none."""
    return rows.agg(F.coalesce(F.sum(F.greatest(F.size(provenance), F.lit(0)).cast("long")), F.lit(0)).alias("n_evidence"))


def known_targets(targets: DataFrame, entities: DataFrame) -> DataFrame:
    """Those of ``targets`` (origin) that the graph has."""
    return targets.join(entities.select(F.col("entity_id").alias("origin")), "origin", "left_semi").distinct()


def causal_paths(edges: DataFrame, starts: DataFrame, kinds: tuple[str, ...] = ("DEPENDS_ON", "AFFECTS"), parts: int | None = None) -> DataFrame:
    """The path that leads to each of ``starts`` (node) by each node's first parent over edges of ``kinds``: ``node, path``.

    It ends at a node without parents, or before one that it has already. One parent per node is chosen first, so that a step is a
    join without growth.
    """
    parents = edges.filter(F.col("kind").isin(*kinds)).select(F.col("target").alias("_at"), F.col("source").alias("_parent"), F.pmod(F.xxhash64("source"), F.lit(SALTS)).alias("_salt"))
    parents = dealt(parents, parts, "_at", "_salt").groupBy("_at", "_salt").agg(F.min("_parent").alias("_parent"))
    parents = materialize(dealt(parents, parts, "_at").groupBy("_at").agg(F.min("_parent").alias("_parent")), "parents")
    front, done, step = starts.select("node", F.array("node").alias("nodes")).distinct(), None, 0
    while True:
        step += 1
        reached = materialize(front.join(parents, F.get("nodes", F.lit(0)) == F.col("_at"), "left").select("node", "nodes", "_parent"), f"causes{step}")
        more = F.col("_parent").isNotNull() & ~F.coalesce(F.array_contains("nodes", F.col("_parent")), F.lit(False))
        ended = reached.filter(~more).select("node", F.concat_ws(">", "nodes").alias("path"))
        done = ended if done is None else done.unionByName(ended)
        front = reached.filter(more).select("node", F.array_prepend("nodes", F.col("_parent")).alias("nodes"))
        if front.isEmpty():
            return done


def _least(links: DataFrame, nodes: DataFrame, label: str) -> DataFrame:
    """``node, ahead, back``: the least node that leads to a node, and the least that it leads to, itself included.

    Both are found at once, over links (back, source, target) of both directions. What a node's label leads to, the node is led to as
    well, so labels jump to those of their labels and settle in few rounds.
    """
    both = nodes.select(F.explode(F.array(F.lit(False), F.lit(True))).alias("back"), "node")
    now, k = materialize(both.select("back", "node", F.col("node").alias("least")), f"{label}-start"), 0
    while True:
        near = now.withColumnRenamed("node", "source").join(links, ["back", "source"]).groupBy("back", F.col("target").alias("node")).agg(F.min("least").alias("near"))
        lower = now.join(near, ["back", "node"], "left").select("back", "node", F.col("least").alias("was"), F.coalesce(F.least("least", "near"), "least").alias("least"))
        jump = now.select("back", F.col("node").alias("least"), F.col("least").alias("next"))
        after = lower.join(jump, ["back", "least"]).select("back", "node", "was", F.least("least", "next").alias("least"))
        after, k = materialize(after, f"{label}{k}"), k + 1
        now = after.select("back", "node", "least")
        if after.filter("was <> least").isEmpty():
            return now.groupBy("node").agg(F.max(F.when(~F.col("back"), F.col("least"))).alias("ahead"), F.max(F.when(F.col("back"), F.col("least"))).alias("back"))


def _on_cycles(links: DataFrame) -> DataFrame:
    """``links`` (source, target) without those that no cycle can hold: of nodes that nothing leads to, or that lead nowhere.

    What is left is looked at again as long as half of it goes; long chains stay, which the caller takes apart anyway.
    """
    k, before = 0, None
    while True:
        ends = links.select(F.explode(F.array(F.struct(F.col("source").alias("node"), F.lit(1).alias("out")), F.struct(F.col("target").alias("node"), F.lit(0).alias("out")))).alias("e")).select("e.*")
        inner = materialize(ends.groupBy("node").agg(F.max("out").alias("out"), F.min("out").alias("least")).filter("out = 1 AND least = 0").select("node"), f"inner{k}")
        kept = links.join(inner, links["source"] == inner["node"], "left_semi").join(inner, links["target"] == inner["node"], "left_semi")
        links = materialize(kept.distinct(), f"trimmed{k}")
        now = links.count()
        if not now or (before is not None and 2 * now > before):
            return links
        k, before = k + 1, now


def strong_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``nodes`` (node) and of ``edges``: the least node of those that lead to each other.

    Nodes that are on no cycle by their edges alone are set aside first. Then each round finds for every node the least that leads to it
    and the least that it leads to. Where both are one, this is the component; all others fall apart by the pair, since nodes of a
    component have the same, and go into the next round with the edges that are left.
    """
    ends = edges.select(F.explode(F.array("source", "target")).alias("node"))
    found = cycles(edges)
    alone = nodes.select("node").unionByName(ends).distinct().join(found, "node", "left_anti")
    return alone.select("node", F.col("node").alias("component")).unionByName(found)


def cycles(edges: DataFrame) -> DataFrame:
    """``node, component`` as by ``strong_components``, of nodes that are in a component with others alone."""
    left = _on_cycles(edges.filter("source <> target").select("source", "target"))
    rest = materialize(left.select(F.explode(F.array("source", "target")).alias("node")).distinct(), "nodes")
    found, k = None, 0
    while True:
        forth = left.select(F.lit(False).alias("back"), "source", "target")
        links = materialize(forth.unionByName(left.select(F.lit(True).alias("back"), F.col("target").alias("source"), F.col("source").alias("target"))), f"both{k}")
        pair = materialize(_least(links, rest, f"least{k}-"), f"pairs{k}")
        done = pair.filter("ahead = back").select("node", F.col("ahead").alias("component"))
        found = done if found is None else found.unionByName(done)
        open_ = pair.filter("ahead <> back")
        a, b = (open_.select(F.col("node").alias(end), F.struct("ahead", "back").alias(f"of_{end}")) for end in ("source", "target"))
        left = materialize(left.join(a, "source").join(b, "target").filter("of_source = of_target").select("source", "target"), f"links{k}")
        rest, k = open_.select("node"), k + 1
        if left.isEmpty():
            # the least node of a component names it, and is alone where no other has its name
            several = found.filter("node <> component").select("component").distinct()
            return materialize(found.join(several, "component", "left_semi").select("node", "component"), "cycles")


def closure(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """``start, node`` of everything that each of ``starts`` (start) reaches in an acyclic graph, itself included; all starts in one frontier."""
    links = materialize(edges.select("source", "target").distinct(), "dag")
    seen = front = materialize(starts.select("start", F.col("start").alias("node")).distinct(), "reach")
    hop = 0
    while True:
        hop += 1
        near = front.join(links, front["node"] == links["source"]).select("start", F.col("target").alias("node")).distinct()
        front = materialize(near.join(seen, ["start", "node"], "left_anti"), f"reach{hop}")
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)


def _folded(links: DataFrame, weights: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """An acyclic graph without its pendants: ``links`` (source, target) that stay, ``node, weight`` of nodes not of weight 1, ``node, above`` of pendants.

    A pendant leads nowhere and has one predecessor, so that whatever else reaches it reaches that one: its weight is added there. A
    pendant's own weight stays with it and is all that it reaches. After the first round, it goes on as long as half of the links go.
    """
    gone, k = None, 0
    while True:
        single = links.groupBy("target").agg(F.count("*").alias("n")).filter("n = 1").select("target")
        ends = materialize(single.join(links.select(F.col("source").alias("target")).distinct(), "target", "left_anti"), f"ends{k}")
        here = materialize(links.join(ends, "target").select(F.col("target").alias("node"), F.col("source").alias("above")), f"pendants{k}")
        n = here.count()
        if gone is not None and (not n or 2 * n < links.count()):
            return links, weights, gone
        gone = here if gone is None else gone.unionByName(here)
        if not n:
            return links, weights, gone
        handed = here.join(weights, "node", "left").groupBy(F.col("above").alias("node")).agg(F.sum(F.coalesce("weight", F.lit(1))).alias("more"))
        summed = weights.join(handed, "node", "full_outer").select("node", (F.coalesce("weight", F.lit(1)) + F.coalesce("more", F.lit(0))).alias("weight"))
        weights = materialize(summed, f"weights{k}")
        links = materialize(links.join(ends, "target", "left_anti").select("source", "target"), f"folded{k}")
        k += 1


def _counted_above(begin: DataFrame, met: DataFrame, pendants: DataFrame) -> DataFrame:
    """``group, component`` of beginnings at pendants that what the group also meets counts already."""
    found = begin.limit(0).select("group", F.col("start").alias("component"))
    at, k = materialize(begin.join(pendants, begin["start"] == pendants["node"]).select("group", "start", "above"), "above"), 0
    while not at.isEmpty():
        hit = at.join(met, (at["group"] == met["group"]) & (at["above"] == met["component"]), "left_semi")
        found = found.unionByName(hit.select("group", F.col("start").alias("component")))
        at, k = materialize(at.join(pendants, at["above"] == pendants["node"]).select("group", "start", pendants["above"]), f"above{k}"), k + 1
    return found.distinct()


def impact(objects: DataFrame, entities: DataFrame, edges: DataFrame) -> DataFrame:
    """``object, n_entities, n_affected``: how many entities each of ``objects`` (object) names (as by ``correlate``), and how many it names or reaches.

    Objects that name the same entities, such as all that are known by their table alone, are one group and share its entities and walks.
    Cycles are condensed, so that nodes of one component are walked once and counted by its size. Pendants of the condensed graph aren't walked but counted with what leads to them; a group that
    begins at a pendant and at what leads to it has it once.
    """
    edges = materialize(edges.select("source", "target"), "links")
    names = materialize(entities.select("entity_id").distinct(), "names")
    table = lambda c: F.concat(F.lit("table "), F.substring_index(c, ".", 1))
    asked = objects.select("object").distinct().join(names.select(F.col("entity_id").alias("object"), F.lit(True).alias("known")), "object", "left")
    asked = materialize(asked.select("object", F.when(F.col("known"), F.concat(F.lit("entity "), "object")).otherwise(table("object")).alias("group")), "asked")
    groups = asked.select("group").distinct()
    named = names.select(F.explode(F.array(F.concat(F.lit("entity "), "entity_id"), table("entity_id"))).alias("group"), "entity_id").join(groups, "group", "left_semi")
    named = materialize(named, "named")
    moved = cycles(edges)
    of = lambda end: moved.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))
    in_part = lambda end: F.coalesce(f"of_{end}", end)
    both = edges.join(of("source"), "source", "left").join(of("target"), "target", "left").select(in_part("source").alias("source"), in_part("target").alias("target"))
    dag = materialize(both.filter("source <> target").distinct(), "condensed")
    dag, weights, pendants = _folded(dag, moved.groupBy("component").agg(F.count("*").alias("weight")).withColumnRenamed("component", "node"))
    begin = materialize(named.join(of("entity_id"), "entity_id", "left").select("group", in_part("entity_id").alias("start")).distinct(), "begin")
    reach = closure(begin, dag)
    met = materialize(begin.join(reach, "start").select("group", F.col("node").alias("component")).distinct(), "met")
    met = met.join(_counted_above(begin, met, pendants), ["group", "component"], "left_anti")
    counts = met.join(weights, met["component"] == weights["node"], "left").groupBy("group").agg(F.sum(F.coalesce("weight", F.lit(1))).alias("n_affected"))
    own = named.groupBy("group").agg(F.count("*").alias("n_entities"))
    return asked.join(own, "group", "left").join(counts, "group", "left").select("object", F.coalesce("n_entities", F.lit(0)).alias("n_entities"), F.coalesce("n_affected", F.lit(0)).alias("n_affected"))


def convergence_links(found: DataFrame, parts: int | None = None) -> DataFrame:
    """``entity, origin, n_origins`` of entities that two origins or more reach: a row per pair, so that no hub's origins meet in one list.

    An entity's origins are shared out by a salt, of which each share meets the entity's count.
    """
    pairs = found.select("entity", "origin", F.pmod(F.xxhash64("origin"), F.lit(SALTS)).alias("salt"))
    pairs = dealt(pairs, parts, "entity", "salt").distinct()
    shares = pairs.groupBy("entity", "salt").agg(F.count("*").alias("n"))
    counts = dealt(shares, parts, "entity").groupBy("entity").agg(F.sum("n").alias("n_origins"), F.collect_list("salt").alias("salts")).filter("n_origins >= 2")
    shared = dealt(counts.select("entity", "n_origins", F.explode("salts").alias("salt")), parts, "entity", "salt")
    return pairs.join(shared, ["entity", "salt"]).select("entity", "origin", "n_origins")
