"""Analytics over an is-a graph: edges isa(child, parent), closure up(c, anc, min_hops, max_hops)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import lexicons
from textloom.functions.text import depth_label
from textloom.operators.linking import WHOLE_WORD, entity_places
from textloom.plans.scratch import settled, spread, together


def closure(isa: DataFrame, concepts: DataFrame | None = None, max_levels: int = 120, paths: bool = False, sent: int = 2_000_000) -> DataFrame:
    """Every concept with all its ancestors and itself (0 hops).

    The closure of the concepts that are parents is made by doubling the length of its paths. All others, the leaves, take their rows
    from their parents', so that each pair is made once, in the task that holds all of the leaf's edges; the parents' rows are sent to all
    tasks up to ``sent`` of them, else joined. A cycle or a path of ``max_levels`` edges raises.
    With ``paths``, also a shortest upward path, the smallest by its nodes."""
    edges = settled(spread(isa.select("child", "parent").where("child is not null and parent is not null"), "child").distinct(), "isa")
    parents = settled(edges.select(F.col("parent").alias("c")).distinct(), "parents")
    own = lambda d: d.select("c", F.col("c").alias("anc"), F.lit(0).alias("min_hops"), F.lit(0).alias("max_hops"), *([F.array("c").alias("path")] if paths else []))
    above = parents.withColumnRenamed("c", "child")
    inner = edges.join(above, "child", "left_semi")
    step = inner.select(F.col("child").alias("c"), F.col("parent").alias("anc"), F.lit(1).alias("min_hops"), F.lit(1).alias("max_hops"), *([F.array("child", "parent").alias("path")] if paths else []))
    known, reach, longest = settled(own(parents).unionByName(step), "parents-up"), 1, 1
    cyclic = not edges.where("child = parent").isEmpty()
    while longest == reach and not cyclic:
        over = known.select(F.col("c").alias("mid"), F.col("anc").alias("top"), F.col("min_hops").alias("lo"), F.col("max_hops").alias("hi"), *([F.col("path").alias("rest")] if paths else []))
        met = known.join(over, F.col("anc") == F.col("mid")).select("c", F.col("top").alias("anc"), (F.col("min_hops") + F.col("lo")).alias("min_hops"), (F.col("max_hops") + F.col("hi")).alias("max_hops"), *([F.concat("path", F.slice("rest", 2, max_levels)).alias("path")] if paths else []))
        known = settled(met.groupBy("c", "anc").agg(F.min("min_hops").alias("min_hops"), F.max("max_hops").alias("max_hops"), *([F.min(F.struct("min_hops", "path"))["path"].alias("path")] if paths else [])), "parents-up")
        reach *= 2
        longest, cyclic = known.agg(F.coalesce(F.max("max_hops"), F.lit(0)), F.coalesce(F.max(F.expr("c = anc and max_hops > 0")), F.lit(False))).first()
        cyclic = cyclic or longest + 1 >= max_levels
    if cyclic:
        raise ValueError(f"the is-a graph has a cycle or more than {max_levels} levels")
    leaves = spread(edges.join(above, "child", "left_anti"), "child", edges.count())
    met = leaves.join(F.broadcast(known) if known.count() <= sent else known, F.col("parent") == F.col("c"))
    figures = [(F.min("min_hops") + 1).alias("min_hops"), (F.max("max_hops") + 1).alias("max_hops")]
    if paths:
        figures.append(F.concat(F.array("child"), F.min(F.struct("min_hops", "path"))["path"]).alias("path"))
    proper = settled(met.groupBy("child", "anc").agg(*figures).withColumnRenamed("child", "c"), "closure-leaves")
    others = edges.select(F.col("child").alias("c"))
    others = others.union(concepts.select(F.col(concepts.columns[0])).where(F.col(concepts.columns[0]).isNotNull())) if concepts is not None else others
    return together([known, proper, settled(own(others.distinct().join(parents, "c", "left_anti")), "closure-leaves")])


def extend_closure(up: DataFrame, added: DataFrame, max_levels: int = 120) -> DataFrame:
    """The closure after ``added`` (child, parent) edges, from the one before them, without the other edges.

    A new path is old paths joined by one added edge or more. Round k makes those of exactly k, from below each added edge to above
    it, so the work follows the pairs that new paths join. It raises if added edges close a cycle."""
    edges = settled(added.select("child", "parent").where("child is not null and parent is not null").distinct(), "added-edges")
    nodes = edges.select(F.col("child").alias("c")).union(edges.select("parent")).distinct().join(up.select("c").distinct(), "c", "left_anti")
    old = up.select("c", "anc", "min_hops", "max_hops").unionByName(nodes.select("c", F.col("c").alias("anc"), F.lit(0).alias("min_hops"), F.lit(0).alias("max_hops")))
    over = edges.join(old.select(F.col("c").alias("parent"), F.col("anc").alias("top"), F.col("min_hops").alias("lo"), F.col("max_hops").alias("hi")), "parent")
    over = settled(over.groupBy(F.col("child").alias("x"), "top").agg((F.min("lo") + 1).alias("lo"), (F.max("hi") + 1).alias("hi")), "over-edges")
    paths, all_ = old, old
    for _ in range(max_levels):
        paths = spread(paths, "c").join(over, F.col("anc") == F.col("x")).groupBy("c", F.col("top").alias("anc")).agg(F.min(F.col("min_hops") + F.col("lo")).alias("min_hops"), F.max(F.col("max_hops") + F.col("hi")).alias("max_hops"))
        paths = settled(paths, "new-paths")
        if paths.isEmpty():
            return settled(spread(all_, "c").groupBy("c", "anc").agg(F.min("min_hops").alias("min_hops"), F.max("max_hops").alias("max_hops")), "closure")
        if not paths.where("c = anc").isEmpty():
            break
        all_ = all_.unionByName(paths)
    raise ValueError("the added edges close a cycle")


def depths(up: DataFrame, root: str = lexicons.ROOT) -> DataFrame:
    """(c, depth): the longest path to the root; null where it can't be reached."""
    return up.groupBy("c").agg(F.max(F.when(F.col("anc") == root, F.col("max_hops"))).alias("depth"))


def proper_ancestors(up: DataFrame, max_hops: int = 120) -> DataFrame:
    return up.where((F.col("min_hops") >= 1) & (F.col("min_hops") <= max_hops))


def lowest_common_ancestors(pairs: DataFrame, up: DataFrame, depth: DataFrame, max_hops: int | None = 5) -> DataFrame:
    """pairs(ca, cb) -> (ca, cb, lca, depth_lca, hops_a, hops_b): the deepest common ancestor, ties to the smallest id.

    It is chosen before the hop limit. Pairs meet by equi-joins on the closure; no pairs beyond those given are made."""
    pairs = pairs.select("ca", "cb").distinct()
    a = up.select(F.col("c").alias("ca"), "anc", F.col("min_hops").alias("hops_a"))
    b = up.select(F.col("c").alias("cb"), "anc", F.col("min_hops").alias("hops_b"))
    met = pairs.join(a, "ca").join(b, ["cb", "anc"]).join(depth.where("depth is not null").select(F.col("c").alias("anc"), F.col("depth").alias("depth_lca")), "anc")
    # the smallest id among the deepest: minimum over (-depth, id)
    best = F.min(F.struct((-F.col("depth_lca")).alias("d"), "anc", "depth_lca", "hops_a", "hops_b"))
    out = met.groupBy("ca", "cb").agg(best.alias("x")).select("ca", "cb", F.col("x.anc").alias("lca"), "x.depth_lca", "x.hops_a", "x.hops_b")
    return out if max_hops is None else out.where((F.col("hops_a") <= max_hops) & (F.col("hops_b") <= max_hops))


def common_ancestors(a: DataFrame, b: DataFrame, up: DataFrame, depth: DataFrame, max_hops: int = 5, together: int = 20_000) -> DataFrame:
    """The same for all pairs of a's and b's concepts whose deepest common ancestor lies within the hop limit of both.

    The sides meet on ancestors within the limit only, and each pair keeps its deepest; pairs out of reach are never made. A pair goes
    if a deeper common ancestor lies beyond the limit: those are asked for by the pairs found, from the few ancestors that are both
    farther and deeper. An ancestor of many concepts, as the root, is split by ``together`` of b's concepts."""
    known = up.join(depth.where("depth is not null").select(F.col("c").alias("anc"), F.col("depth").alias("depth_lca")), "anc")
    side = lambda d, c, h: d.select(F.col("concept").alias(c)).where(f"{c} is not null").distinct().join(known.select(F.col("c").alias(c), "anc", "depth_lca", F.col("min_hops").alias(h)), c)
    above_a, above_b = side(a, "ca", "hops_a"), side(b, "cb", "hops_b")
    near_a, near_b = above_a.where(F.col("hops_a") <= max_hops), above_b.where(F.col("hops_b") <= max_hops).drop("depth_lca")
    parts = near_b.groupBy("anc").agg(F.ceil(F.count("*") / together).cast("int").alias("parts"))
    split_a = near_a.join(parts, "anc").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    split_b = near_b.join(parts, "anc").withColumn("part", F.pmod(F.xxhash64("cb"), "parts").cast("int"))
    met = split_a.drop("parts").join(split_b.drop("parts"), ["anc", "part"])
    best = F.min(F.struct((-F.col("depth_lca")).alias("d"), "anc", "depth_lca", "hops_a", "hops_b"))
    found = met.groupBy("ca", "cb").agg(best.alias("x")).select("ca", "cb", F.col("x.anc").alias("lca"), "x.depth_lca", "x.hops_a", "x.hops_b")
    if up.where(F.col("min_hops") > max_hops).isEmpty():
        return found
    found = settled(found, "common-ancestors")

    def beyond(far: DataFrame, c: str, other: DataFrame, d: str) -> DataFrame:
        deeper = far.select(c, F.col("anc").alias("x"), F.col("depth_lca").alias("depth_x"))
        asked = found.join(deeper, c).where("depth_x > depth_lca or (depth_x = depth_lca and x < lca)")
        return asked.select("ca", "cb", "x").join(other.select(d, F.col("anc").alias("x")), [d, "x"], "left_semi").select("ca", "cb")

    lost = beyond(above_a.where(F.col("hops_a") > max_hops), "ca", above_b, "cb").union(beyond(above_b.where(F.col("hops_b") > max_hops), "cb", above_a, "ca"))
    return found.join(lost.distinct(), ["ca", "cb"], "left_anti").select(found.columns)


def branch_pairs(a: DataFrame, b: DataFrame, up: DataFrame, depth: DataFrame, max_hops: int = 5, dedupe: bool = True) -> DataFrame:
    """a, b (entity, concept): entity pairs on a common branch. Each concept pair's ancestor is found once.

    With ``dedupe`` one entity pair stays for each concept pair: the smallest names."""
    lca = common_ancestors(a, b, up, depth, max_hops)
    names = lambda d, s: d.where("concept is not null").groupBy("concept").agg(F.min("entity").alias(f"entity_{s}")) if dedupe else d.select("concept", F.col("entity").alias(f"entity_{s}"))
    d = lambda s: depth.where("depth is not null").select(F.col("c").alias(f"c{s}"), F.col("depth").alias(f"depth_{s}"))
    met = lca.join(names(a, "a").withColumnRenamed("concept", "ca"), "ca").join(names(b, "b").withColumnRenamed("concept", "cb"), "cb").join(d("a"), "ca").join(d("b"), "cb")
    return met.select("entity_a", "entity_b", F.col("ca").alias("concept_a"), F.col("cb").alias("concept_b"), "depth_a", "depth_b", F.col("lca").alias("lca_concept"), "depth_lca", "hops_a", "hops_b", (F.col("depth_b") - F.col("depth_a")).alias("depth_diff"))


def categories(concepts: DataFrame, up: DataFrame, top_level: list[tuple[str, str]] = lexicons.TOP_LEVEL, root: str = lexicons.ROOT, root_label: str = "SNOMED root", hop_cap: int = 250) -> DataFrame:
    """(c, category): the nearest top-level ancestor's label, ties to the smallest id."""
    labels = concepts.sparkSession.createDataFrame(top_level, "anc string, label string")
    asked = concepts.select("c").distinct()
    near = up.join(F.broadcast(labels), "anc").where(F.col("min_hops") <= hop_cap).groupBy("c").agg(F.min(F.struct("min_hops", "anc", "label"))["label"].alias("label"))
    return asked.join(near, "c", "left").select("c", F.when(F.col("c") == root, root_label).otherwise(F.coalesce("label", F.lit("Other or unclassified"))).alias("category"))


def category_rollup(pairs: DataFrame, category: DataFrame) -> DataFrame:
    """Totals and shares of depth order by the category of the pair's ancestor, and an ALL row."""
    met = pairs.join(category.withColumnRenamed("c", "lca_concept"), "lca_concept")
    n = F.count("*")
    counts = met.rollup("category").agg(F.grouping("category").alias("all"), n.alias("total_pairs"), F.count_if(F.col("depth_diff") < 0).alias("n_a_deeper"), F.count_if(F.col("depth_diff") > 0).alias("n_b_deeper"), F.count_if(F.col("depth_diff") == 0).alias("n_equal_depth"))
    share = lambda c: F.round(100.0 * F.col(c) / F.col("total_pairs"), 2)
    return counts.where("total_pairs > 0").select(F.when(F.col("all") == 1, "ALL").otherwise(F.col("category")).alias("category"), "total_pairs", "n_a_deeper", "n_b_deeper", "n_equal_depth", share("n_a_deeper").alias("pct_a_deeper"), share("n_b_deeper").alias("pct_b_deeper"), share("n_equal_depth").alias("pct_equal_depth"))


def divergent_pair_per_category(pairs: DataFrame, category: DataFrame, min_diff: int = 1) -> DataFrame:
    met = pairs.where((F.col("concept_a") != F.col("concept_b")) & (F.abs("depth_diff") >= min_diff)).join(category.withColumnRenamed("c", "lca_concept"), "lca_concept")
    first = F.min(F.struct((-F.abs("depth_diff")).alias("d"), "entity_a", "entity_b", "concept_a", "concept_b", "depth_diff"))
    return met.groupBy("category").agg(first.alias("x")).select("category", "x.entity_a", "x.entity_b", "x.concept_a", "x.concept_b", "x.depth_diff")


def compact_path(path):
    """Up to six nodes whole; else the first two, an ellipsis, the last three."""
    return F.when(F.size(path) <= 6, path).otherwise(F.concat(F.slice(path, 1, 2), F.array(F.lit("…")), F.slice(path, F.size(path) - 2, 3)))


def ancestors_within(seeds: DataFrame, up: DataFrame, hops: int = -1) -> DataFrame:
    """(concept, hops): all ancestors of the seeds, to the nearest seed; a negative limit is none."""
    near = up if hops < 0 else up.where(F.col("min_hops") <= hops)
    return near.join(seeds.select(F.col("concept").alias("c")).distinct(), "c", "left_semi").groupBy(F.col("anc").alias("concept")).agg(F.min("min_hops").alias("hops"))


def induced_edges(isa: DataFrame, nodes: DataFrame) -> DataFrame:
    n = nodes.select("concept").distinct()
    return isa.join(n.withColumnRenamed("concept", "child"), "child", "left_semi").join(n.withColumnRenamed("concept", "parent"), "parent", "left_semi").select("child", "parent").distinct()


def capped_neighbourhood(seeds: DataFrame, isa: DataFrame, up_hops: int = 3, down_hops: int = 1, max_nodes: int = 320) -> DataFrame:
    """(concept, step): the seeds, then level by level what lies above them and below them, until ``max_nodes`` concepts are found.

    Steps: 0 the seeds, 1 to ``up_hops`` upwards, then downwards from the seeds. Both directions share the budget; a level that no
    longer fits gives its smallest ids, and nothing is expanded beyond. Seeds always stay. As long as a level is expanded there are
    fewer than ``max_nodes`` concepts, so frontier and visited concepts are sent to the edges, never edges to each other."""
    budget = max(60, max_nodes)
    start = settled(seeds.select("concept").where("concept is not null").distinct(), "bfs-seeds")
    found, n = start.withColumn("step", F.lit(0)), start.count()
    for src, dst, hops, before in (("child", "parent", up_hops, 0), ("parent", "child", down_hops, up_hops)):
        own, frontier = start, start
        for k in range(1, hops + 1):
            if n >= budget:
                return found
            reached = isa.join(F.broadcast(frontier.withColumnRenamed("concept", src)), src, "left_semi").select(F.col(dst).alias("concept")).where("concept is not null")
            reached = reached.join(F.broadcast(own), "concept", "left_anti")
            # known from the other direction: they cost nothing and are expanded again
            again = reached.join(F.broadcast(found.select("concept")), "concept", "left_semi").distinct()
            new = reached.join(F.broadcast(found.select("concept")), "concept", "left_anti").distinct().orderBy("concept").limit(budget - n)
            level = settled(again.withColumn("new", F.lit(False)).unionByName(new.withColumn("new", F.lit(True))), "bfs-level")
            added = level.where("new").select("concept", F.lit(before + k).alias("step"))
            n, found = n + added.count(), found.unionByName(added)
            frontier = level.select("concept")
            own = own.unionByName(frontier)
            if frontier.isEmpty():
                break
    return found


def seed_attribution(seeds: DataFrame) -> DataFrame:
    """seeds(concept, case_id, side) -> (concept, seed_sides, seed_cases): the sides and cases that a concept comes from."""
    listed = lambda c, sep: F.array_join(F.sort_array(F.collect_set(F.col(c).cast("string"))), sep)
    return seeds.where("concept is not null").groupBy("concept").agg(listed("side", ",").alias("seed_sides"), listed("case_id", "+").alias("seed_cases"))


def neighbourhood_graph(seeds: DataFrame, isa: DataFrame, labels: DataFrame, **limits) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the seeds' capped neighbourhood: nodes(id, kind, label, sctid, seed_sides, seed_cases), edges(src, dst, rel)."""
    near = capped_neighbourhood(seeds, isa, **limits).select("concept")
    named = near.join(labels, "concept", "left").join(seed_attribution(seeds), "concept", "left")
    none = lambda c: F.coalesce(c, F.lit("")).alias(c)
    nodes = named.select(F.col("concept").alias("id"), F.lit("concept").alias("kind"), F.substring(F.coalesce("label", "concept"), 1, 120).alias("label"), F.col("concept").alias("sctid"), none("seed_sides"), none("seed_cases"))
    return nodes, induced_edges(isa, near).select(F.col("child").alias("src"), F.col("parent").alias("dst"), F.lit("is_a").alias("rel"))


def edges_above(seeds: DataFrame, isa: DataFrame, hops: int) -> DataFrame:
    """The distinct edges from the seeds' concepts and from their ancestors, ``hops`` levels of edges in all."""
    level = settled(seeds.select("concept").distinct(), "hull-concepts")
    out = []
    for _ in range(hops):
        out.append(settled(isa.join(level.withColumnRenamed("concept", "child"), "child", "left_semi").select("child", "parent").distinct(), "hull-edges"))
        level = out[-1].select(F.col("parent").alias("concept")).distinct()
    return settled(together(out).distinct(), "hull-edges")


def concept_hull(seeds: DataFrame, isa: DataFrame, hops: int = 2, cap: int = 90, sent: int = 2_000_000) -> DataFrame:
    """seeds(prefix, concept) -> (prefix, concept): each graph's concepts and their ancestors within ``hops``, up to ``cap`` by (step, id); seeds always stay.

    Each concept's ancestors are found once for all graphs, and sent to all tasks up to ``sent`` rows; graphs are dealt by their prefix and
    shuffled no more."""
    level = settled(seeds.select("concept").distinct(), "hull-seeds").select(F.col("concept").alias("seed"), "concept")
    edges = edges_above(level, isa, hops) if hops else isa
    rows = level.withColumn("step", F.lit(0))
    for k in range(1, hops + 1):
        level = level.join(edges, level["concept"] == edges["child"]).select("seed", F.col("parent").alias("concept")).distinct()
        rows = rows.unionByName(level.withColumn("step", F.lit(k)))
    above = settled(rows.groupBy("seed", "concept").agg(F.min("step").alias("step")), "hull-ancestors")
    own = seeds.select("prefix", F.col("concept").alias("seed"))
    nearest = own.join(_sent(above, sent), "seed").groupBy("prefix", "concept").agg(F.min("step").alias("step"))
    r = F.row_number().over(Window.partitionBy("prefix").orderBy("step", "concept"))
    return nearest.withColumn("r", r).where((F.col("r") <= cap) | (F.col("step") == 0)).select("prefix", "concept")


def _sent(rows: DataFrame, most: int) -> DataFrame:
    """``rows`` for a join, sent to all tasks if there are ``most`` or fewer."""
    return F.broadcast(rows) if rows.count() <= most else rows


def pair_visuals(pairs: DataFrame, up: DataFrame) -> DataFrame:
    """pairs(category, entity_a, entity_b, concept_a, concept_b, lca_concept, depth_a, depth_b) -> what a panel shows: title, depth
    order and both compact paths from the common ancestor down. ``up`` has paths."""
    one = lambda s: up.select(F.col("c").alias(f"concept_{s}"), F.col("anc").alias("lca_concept"), compact_path(F.reverse("path")).alias(f"path_{s}"))
    met = pairs.join(one("a"), ["concept_a", "lca_concept"]).join(one("b"), ["concept_b", "lca_concept"])
    title = F.concat("category", F.lit(lexicons.PANEL_TITLE[0]), "entity_a", F.lit(lexicons.PANEL_TITLE[1]), "entity_b", F.lit(lexicons.PANEL_TITLE[2]))
    return met.select("category", title.alias("title"), depth_label(F.col("depth_a"), F.col("depth_b")).alias("mid"), "path_a", "path_b", "entity_a", "entity_b", "depth_a", "depth_b")


def first_parent_chain(concepts: DataFrame, isa: DataFrame, steps: int = 3) -> DataFrame:
    """(c, chain): the smallest parent's smallest parent and so on."""
    first = isa.groupBy("child").agg(F.min("parent").alias("parent"))
    out = concepts.select("c", F.col("c").alias("_at"), F.array().cast("array<string>").alias("chain"))
    for _ in range(steps):
        out = out.join(first, out["_at"] == first["child"], "left").select("c", F.col("parent").alias("_at"), F.when(F.col("parent").isNotNull(), F.array_append("chain", F.col("parent"))).otherwise(F.col("chain")).alias("chain"))
    return out.drop("_at")


def explanation_graph(mentions: DataFrame, isa: DataFrame) -> DataFrame:
    """mentions(sentence, entity, concept) -> edges(src, dst, rel): sentence, entity and concept nodes.

    Each kind of edges is made distinct by itself, before its nodes get their names; is-a edges in the tasks in which they meet the concepts."""
    node = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    m = mentions.select("sentence", "entity").distinct().select(node("S:", "sentence").alias("src"), node("E:", "entity").alias("dst"), F.lit("mentions").alias("rel"))
    maps = settled(mentions.select("entity", "concept").where("concept is not null").distinct(), "graph-maps")
    t = maps.select(node("E:", "entity").alias("src"), node("C:", "concept").alias("dst"), F.lit("maps_to").alias("rel"))
    c = maps.select(F.col("concept").alias("child")).distinct()
    i = isa.select("child", "parent").join(c, "child", "left_semi").distinct().select(node("C:", "child").alias("src"), node("C:", "parent").alias("dst"), F.lit("is_a").alias("rel"))
    return m.unionByName(t).unionByName(i)


def explanation_graphs(sentences: DataFrame, linked: DataFrame, isa: DataFrame, hull_hops: int = 2, cap: int = 90, hull: DataFrame | None = None, sent: int = 2_000_000) -> DataFrame:
    """sentences(prefix, i, text), linked(prefix, entity, concept) -> distinct edges(prefix, src, dst, rel) of one graph for each prefix.

    A sentence mentions the entities that it holds; is-a edges lie within the hull of the graph's concepts. Ids: prefix and S, E: or C:.
    ``hull`` is the hull (prefix, concept) where it has been made already."""
    own = settled(linked.where("concept is not null").select("prefix", F.lower(F.trim("entity")).alias("entity"), "concept"), "linked")
    id_ = lambda kind, c: F.concat(F.col("prefix").cast("string"), F.lit(kind), F.col(c).cast("string"))
    # few where many graphs share their entities: then they are sent to the texts' words
    names = settled(own.select("entity").distinct(), "graph-entities")
    # a graph's rows lie in one task from here on: what meets within it is found by windows, which shuffle nothing once more
    dealt = own.where("concept is not null").repartition("prefix").distinct()
    odd = not names.where(f"not ({WHOLE_WORD})").isEmpty()
    found = entity_places(sentences, names, ("prefix", "i"), odd).withColumn("own", F.lit(False))
    found = found.unionByName(own.select("entity", "prefix", F.lit(None).cast(found.schema["i"].dataType).alias("i"), F.lit(True).alias("own"))).repartition("prefix").distinct()
    held = found.withColumn("held", F.max("own").over(Window.partitionBy("prefix", "entity"))).where("held and not own and prefix is not null")
    mentions = held.select("prefix", id_("S", "i").alias("src"), id_("E:", "entity").alias("dst"), F.lit("mentions").alias("rel"))
    maps = dealt.select("prefix", id_("E:", "entity").alias("src"), id_("C:", "concept").alias("dst"), F.lit("maps_to").alias("rel"))
    hull = concept_hull(dealt, isa, hull_hops, cap) if hull is None else hull.repartition("prefix")
    parents = edges_above(own, isa, hull_hops + 1).groupBy(F.col("child").alias("concept")).agg(F.collect_set("parent").alias("parents"))
    end = lambda node, child: F.struct(node.alias("node"), child.alias("child"))
    ends = F.concat(F.array(end(F.col("concept"), F.lit(None).cast(own.schema["concept"].dataType))), F.transform(F.coalesce("parents", F.array().cast(parents.schema["parents"].dataType)), lambda p: end(p, F.col("concept"))))
    met = hull.join(_sent(settled(parents, "hull-parents"), sent), "concept", "left").select("prefix", F.explode(ends).alias("e")).select("prefix", "e.*")
    inner = met.withColumn("inside", F.max(F.col("child").isNull()).over(Window.partitionBy("prefix", "node"))).where("case when prefix is not null then inside end and child is not null")
    is_a = inner.select("prefix", id_("C:", "child").alias("src"), id_("C:", "node").alias("dst"), F.lit("is_a").alias("rel"))
    return mentions.unionByName(maps).unionByName(is_a)


def explanation_nodes(sentences: DataFrame, linked: DataFrame, isa: DataFrame, labels: DataFrame, hull_hops: int = 2, cap: int = 90, hull: DataFrame | None = None, sent: int = 500_000) -> DataFrame:
    """(prefix, id, kind, label, sctid) of the graphs whose edges ``explanation_graphs`` gives; labels(concept, label).

    Sentences show 200 characters, concepts 100 of their label (of their id without one), entities themselves. A sentence
    that mentions nothing is a node, too."""
    own = linked.where("concept is not null").select("prefix", F.lower(F.trim("entity")).alias("entity"), "concept").where("entity <> ''")
    prefix, none = F.col("prefix").cast("string"), F.lit(None).cast("string").alias("sctid")
    cut = F.when(F.char_length("text") > 200, F.concat(F.substring("text", 1, 200), F.lit("…"))).otherwise(F.col("text"))
    s = sentences.select("prefix", F.concat(prefix, F.lit("S"), F.col("i").cast("string")).alias("id"), F.lit("sentence").alias("kind"), cut.alias("label"), none)
    e = own.select("prefix", "entity").repartition("prefix").distinct().select("prefix", F.concat(prefix, F.lit("E:"), "entity").alias("id"), F.lit("entity").alias("kind"), F.col("entity").alias("label"), none)
    name = settled(labels.where("label <> ''").groupBy("concept").agg(F.substring(F.min("label"), 1, 100).alias("label")), "graph-labels")
    hull = (concept_hull(own.repartition("prefix").distinct(), isa, hull_hops, cap) if hull is None else hull).join(_sent(name, sent), "concept", "left")
    c = hull.select("prefix", F.concat(prefix, F.lit("C:"), F.col("concept").cast("string")).alias("id"), F.lit("concept").alias("kind"), F.substring(F.coalesce("label", F.col("concept").cast("string")), 1, 100).alias("label"), F.col("concept").cast("string").alias("sctid"))
    return s.unionByName(e).unionByName(c)


def trimmed_graphs(nodes: DataFrame, edges: DataFrame, max_nodes: int = 130) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of every ``prefix`` at once, at most ``max_nodes`` nodes each: all concepts and entities, and sentences by falling
    degree (then id) in the room they leave.

    Nodes and edges are dealt by their prefix together and once. Windows over a node's own row and its edges' ends find degrees and what is
    kept, those over an edge's two ends the edges; a graph lies in one task, and only kept rows are written."""
    fields = lambda d: [f for f in d.columns if f != "prefix"]
    node, edge = F.struct(*fields(nodes)), F.struct(*fields(edges))
    none = lambda d: F.lit(None).cast(d.select(F.struct(*fields(d)).alias("x")).schema["x"].dataType)
    rows = nodes.select("prefix", node.alias("node"), none(edges).alias("edge")).unionByName(edges.where("prefix is not null").select("prefix", none(nodes).alias("node"), edge.alias("edge"))).repartition("prefix")
    end = lambda c, side: F.struct(F.col(c).alias("id"), F.lit(side).alias("side"))
    ends = F.when(F.col("node").isNotNull(), F.array(end("node.id", 0))).otherwise(F.array(end("edge.src", 0), end("edge.dst", 1)))
    at = rows.withColumn("end", F.explode(ends)).select("prefix", "node", "edge", "end.*")
    own, graph = Window.partitionBy("prefix", "id"), Window.partitionBy("prefix")
    cut, fixed = F.col("node.kind") == "sentence", F.col("node.kind") != "sentence"
    at = at.withColumn("degree", F.count(F.when(F.col("id").isNotNull(), F.col("side"))).over(own) - F.count("node").over(own))
    # sentences are the first in the order of their ranks
    at = at.withColumn("r", F.row_number().over(graph.orderBy(F.when(cut, 0).otherwise(1), F.desc("degree"), "id"))).withColumn("n_fixed", F.count_if(fixed).over(graph))
    at = at.withColumn("stays", F.coalesce(fixed | (cut & (F.col("r") + F.when(F.col("prefix").isNotNull(), F.col("n_fixed")).otherwise(0) <= max_nodes)), F.lit(False)))
    at = at.withColumn("kept", F.max("stays").over(own) & F.col("id").isNotNull()).where("stays or edge is not null")
    at = at.withColumn("whole", F.min("kept").over(Window.partitionBy("prefix", "edge"))).where("stays or (whole and side = 0)")
    out = settled(at.select("prefix", "node", "edge"), "trimmed-graphs")
    # ends without a node of their own are cut, too
    given = lambda d, c: out.where(f"{c} is not null").select(*(F.col(f) if f == "prefix" else F.col(f"{c}.{f}") for f in d.columns))
    return given(nodes, "node"), given(edges, "edge")


def split_sentences(docs: DataFrame) -> DataFrame:
    """docs(prefix, text) -> (prefix, i, text): parts between ends of sentences, without blanks around."""
    parts = F.filter(F.transform(F.split(F.regexp_replace("text", r"^\s+|\s+$", ""), r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")
    return docs.select("prefix", F.posexplode(parts).alias("i", "text"))


def _kind(c: str):
    """The kind of a node by its id; a null id counts as a sentence."""
    return F.when(F.col(c).startswith("C:"), "concept").when(F.col(c).startswith("E:"), "entity").otherwise("sentence")


def trimmed_graph(edges: DataFrame, max_nodes: int = 130) -> tuple[DataFrame, DataFrame]:
    """(nodes(id, kind, degree), edges): all concepts and entities, then sentences by falling degree (then id) up to the limit; the edges whose
    both ends are kept.

    Edges are made once. Only sentences are cut, so that edges meet the few that stay and are never shuffled by their ends; where concepts
    and entities leave no room, sentences are not even counted."""
    edges = settled(edges, "graph-edges")
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).withColumn("kind", _kind("id"))
    counted = lambda rows: rows.groupBy("id", "kind").agg(F.count("*").alias("degree"))
    nodes = settled(counted(ends.where("kind <> 'sentence'")), "graph-nodes")
    room = max(0, max_nodes - nodes.count())
    fixed = lambda c: _kind(c) != "sentence"
    if not room:
        return nodes, edges.where(fixed("src") & fixed("dst"))
    kept = settled(counted(ends.where("kind = 'sentence'")).orderBy(F.desc("degree"), "id").limit(room), "graph-sentences")
    end = lambda c: kept.select(F.col("id").alias(f"_{c}"))
    met = edges.join(end("src"), F.col("src") == F.col("_src"), "left").join(end("dst"), F.col("dst") == F.col("_dst"), "left")
    return nodes.unionByName(kept), met.where((fixed("src") | F.col("_src").isNotNull()) & (fixed("dst") | F.col("_dst").isNotNull())).select(edges.columns)
