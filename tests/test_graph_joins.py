"""Joins over random is-a graphs and dictionaries against brute force."""

import random
import re

import pytest

from textloom.operators import linking as N
from textloom.operators import ontology as O
from textloom.operators import paired as P
from textloom.plans import scratch


@pytest.fixture(scope="module")
def graph(spark):
    """A random acyclic graph with long chains: edges to the root at n0."""
    rng = random.Random(2)
    edges = {(f"n{k}", f"n{max(0, k - rng.choice([1, 1, 1, 2, 3, 9]))}") for k in range(1, 60) for _ in range(rng.choice([1, 1, 2]))}
    isa = spark.createDataFrame(sorted(edges), "child string, parent string")
    return edges, isa, O.closure(isa).cache()


def walks(edges):
    """(c, anc) -> (shortest, longest)."""
    up = {}
    nodes = {x for e in edges for x in e}
    for c in nodes:
        level = {c}
        for hops in range(len(nodes)):
            for x in level:
                lo, hi = up.get((c, x), (hops, hops))
                up[c, x] = min(lo, hops), max(hi, hops)
            level = {p for n, p in edges if n in level}
    return up


@pytest.mark.parametrize("max_hops, together", [(2, 20_000), (3, 4), (60, 3)])
def test_common_ancestors_within_hops(spark, graph, max_hops, together):
    edges, _, up = graph
    all_ = walks(edges)
    depth = {c: hi for (c, anc), (_, hi) in all_.items() if anc == "n0"}
    left, right = [f"n{k}" for k in range(0, 60, 2)], [f"n{k}" for k in range(5, 60)]
    want = set()
    for a in left:
        for b in right:
            common = [x for x in depth if (a, x) in all_ and (b, x) in all_]
            lca = min(common, key=lambda x: (-depth[x], x))
            ha, hb = all_[a, lca][0], all_[b, lca][0]
            if ha <= max_hops and hb <= max_hops:
                want.add((a, b, lca, depth[lca], ha, hb))
    frame = lambda rows: spark.createDataFrame([(r,) for r in [*rows, None, rows[0]]], "concept string")
    got = O.common_ancestors(frame(left), frame(right), up, O.depths(up, "n0"), max_hops, together).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


@pytest.mark.parametrize("budget", [60, 61, 70, 1000])
def test_neighbourhood_within_a_budget(spark, budget):
    rng = random.Random(budget)
    edges = {(f"c{rng.randrange(400)}", f"p{rng.randrange(90)}") for _ in range(900)} | {(f"p{k}", f"q{rng.randrange(40)}") for k in range(90)}
    seeds = [f"p{k}" for k in range(0, 90, 5)]
    steps, n = dict.fromkeys(seeds, 0), len(seeds)
    for up, hops, before in ((True, 2, 0), (False, 2, 2)):
        seen, frontier = set(seeds), set(seeds)
        for k in range(1, hops + 1):
            if len(steps) >= budget:
                break
            next_ = {y if up else x for x, y in edges if (x if up else y) in frontier} - seen
            new = sorted(next_ - set(steps))[: budget - len(steps)]
            frontier = (next_ & set(steps)) | set(new)
            seen |= frontier
            steps |= dict.fromkeys(new, before + k)
    isa = spark.createDataFrame(sorted(edges), "child string, parent string")
    got = O.capped_neighbourhood(spark.createDataFrame([(s,) for s in [*seeds, None]], "concept string"), isa, 2, 2, budget).collect()
    assert sorted((r.concept, r.step) for r in got) == sorted(steps.items())
    assert len(O.capped_neighbourhood(spark.createDataFrame([(f"p{k}",) for k in range(80)], "concept string"), isa, 2, 2, 60).collect()) == 80  # seeds stay


def brute_links(entities, rows, most_union):
    rows = sorted({(t.strip().lower(), c, r) for c, t, r in rows})
    words = lambda t: {w for w in re.findall("[a-z0-9]+", t) if len(w) >= 2}
    out = {}
    for e in {x.lower() for x in entities}:
        exact = [(r, c) for t, c, r in rows if t == e]
        postings = [p for p in ({row for row in rows if w in words(row[0])} for w in words(e)) if p]
        sizes = sorted((len({row for row in rows if w in words(row[0])}), w) for w in words(e) if any(w in words(row[0]) for row in rows))
        found = set()
        if postings:
            both, any_ = set.intersection(*postings), set.union(*postings)
            rarest = sizes[0][1]
            found = both or (any_ if len(any_) <= most_union else {row for row in rows if rarest in words(row[0])})
        inside = lambda t: (e in t) if " " in e or "-" in e or len(e) < 2 else re.search(rf"(?<![a-z0-9]){re.escape(e)}(?![a-z0-9])", t)
        best = min(((r, len(t), t, c) for t, c, r in found if inside(t)), default=None)
        out[e] = min(exact)[1] if exact else best[3] if best else None
    return out


@pytest.mark.parametrize("most_union", [250_000, 12, 0])
def test_links_by_the_rarest_word(spark, most_union):
    rng = random.Random(8)
    pool = ["spring", "ring", "ball", "eyeball", "red", "hot", "a", "dis-ease", "disease", "disease", "disease"]
    rows = [(f"c{k % 40}", " ".join(rng.choice(pool) for _ in range(rng.randrange(1, 4))) + rng.choice(["", " ", " (x)"]), rng.randrange(2)) for k in range(150)]
    entities = {" ".join(rng.choice([*pool, "unknown", "ring ball", "pring"]) for _ in range(rng.randrange(1, 4))) for _ in range(150)} | {"Spring", "ease", "ring red"}
    d = spark.createDataFrame(rows, "concept string, term string, rank int")
    e = spark.createDataFrame([(x,) for x in entities], "entity string")
    assert {r.entity: r.concept for r in N.link_best(e, d, most_union).collect()} == brute_links(entities, rows, most_union)


@pytest.mark.parametrize("seed", [1, 2])
def test_extended_closure_is_the_closure_of_all_edges(spark, graph, seed):
    edges, isa, up = graph
    rng = random.Random(seed)
    late = {e for e in edges if rng.random() < 0.3} | {("new1", "n5"), ("new2", "new1")}
    frame = lambda rows: spark.createDataFrame(sorted(rows), "child string, parent string")
    before = O.closure(frame(edges - late))
    got = {tuple(r) for r in O.extend_closure(before, frame(late)).select("c", "anc", "min_hops", "max_hops").collect()}
    assert got == {(c, anc, lo, hi) for (c, anc), (lo, hi) in walks(edges | late).items()}
    with pytest.raises(ValueError, match="cycle"):
        O.extend_closure(up, frame({("n0", "n59")}))


@pytest.mark.parametrize("sent", [2_000_000, 0])
def test_closure_makes_each_pair_of_a_leaf_once(spark, graph, monkeypatch, sent):
    edges, isa, _ = graph
    made = []

    def keep(df, name):
        out = settled(df, name)
        if name.startswith("closure"):
            made.append(out.count())
        return out

    settled = O.settled
    monkeypatch.setattr(O, "settled", keep)
    lone = spark.createDataFrame([("alone",), ("n3",), (None,)], "c string")
    got = [tuple(r)[:4] for r in O.closure(isa.union(isa), lone, paths=True, sent=sent).select("c", "anc", "min_hops", "max_hops").collect()]
    leaves = {c for c, _ in edges} - {p for _, p in edges} | {"alone"}
    assert dict(((c, anc), (lo, hi)) for c, anc, lo, hi in got) == walks(edges) | {("alone", "alone"): (0, 0)} and len(got) == len(walks(edges)) + 1
    assert sum(made) == sum(c in leaves for c, _, _, _ in got)
    with pytest.raises(ValueError, match="cycle"):
        O.closure(isa.union(spark.createDataFrame([("n0", "n59")], "child string, parent string")), sent=sent)


def test_closure_paths_are_the_smallest_shortest(spark, graph):
    edges, isa, _ = graph
    best = {}
    level = {(c,) for e in edges for c in e}
    while level:
        for path in sorted(level):
            best.setdefault((path[0], path[-1]), path)
        level = {(*p, up) for p in level for n, up in edges if n == p[-1]}
        level = {p for p in level if (p[0], p[-1]) not in best}
    assert {(r.c, r.anc): tuple(r.path) for r in O.closure(isa, paths=True).collect()} == best


def test_tasks_follow_rows_and_not_shuffle_partitions(spark):
    assert scratch.spread(spark.range(1000), "id", each=100).rdd.getNumPartitions() == 10


@pytest.mark.parametrize("most", [10_000, 0, 30])
@pytest.mark.parametrize("min_gap", [0, 3])
def test_related_pairs_of_small_and_wide_cases(spark, graph, most, min_gap):
    edges, _, up = graph
    all_ = walks(edges)
    rng = random.Random(4)
    depth = {c: hi for (c, anc), (_, hi) in all_.items() if anc == "n0"}
    rows = sorted({(case, rng.choice("AB"), f"e{k % 7}", f"n{k}", depth[f"n{k}"], 1 + k % 3) for case in range(6) for k in (rng.randrange(60) for _ in range(4 + 5 * case))})
    rows += [(1, "A", "lone", None, None, 1), (1, "B", "odd", "x9", 2, 1)]
    want = set()
    for ca, sa, ea, a, da, na in rows:
        for cb, sb, eb, b, db, nb in rows:
            if ca == cb and (sa, sb) == ("A", "B") and None not in (a, b) and abs(da - db) >= min_gap:
                want |= {(ca, ea, eb, a, b, da, db, na, nb, s, abs(da - db)) for s, pair in (("A", (b, a)), ("B", (a, b))) if a != b and pair in all_}
    mentions = spark.createDataFrame(rows, "case_id long, side string, entity string, concept string, depth int, n long")
    got = P.related_pairs(mentions, up, min_gap, most).select("case_id", "entity_a", "entity_b", "ca", "cb", "depth_a", "depth_b", "count_a", "count_b", "broader", "gap").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_hulls_meet_only_edges_above_their_concepts(spark, graph):
    edges, isa, _ = graph
    seeds = spark.createDataFrame([(1, "n20"), (2, "n20"), (2, "n9")], "prefix long, concept string")
    first = {(c, p) for c, p in edges if c in ("n20", "n9")}
    want = first | {(c, p) for c, p in edges if c in {p for _, p in first}}
    got = [tuple(r) for r in O.edges_above(seeds, isa.union(isa), 2).collect()]
    assert len(got) == len(want) and set(got) == want


def test_graphs_are_shuffled_by_their_prefix_only(spark):
    """Against sets; what is dealt by the prefix once isn't shuffled by anything else."""
    rng = random.Random(8)
    pool = ["pain", "ache", "cold", "cough", "the"]
    texts = [(g, i, " ".join(rng.choices(pool, k=4))) for g in range(12) for i in range(3)] * 2
    rows = [(g, rng.choice(pool), f"c{rng.randrange(9)}") for g in range(12) for _ in range(4)] * 2
    isa = sorted({(f"c{a}", f"c{b}") for a in range(1, 30) for b in rng.sample(range(a), min(a, 2))})
    want = {(g, f"{g}S{i}", f"{g}E:{e}", "mentions") for g, i, t in texts for h, e, _ in rows if g == h and e in t.split()} | {(g, f"{g}E:{e}", f"{g}C:{c}", "maps_to") for g, e, c in rows}
    for g in range(12):
        step = {c: 0 for h, _, c in rows if g == h}
        for k in (1, 2):
            step |= {p: k for c, p in isa if step.get(c) == k - 1 and p not in step}
        hull = {c for r, (c, k) in enumerate(sorted(step.items(), key=lambda x: (x[1], x[0]))) if r < 5 or not k}
        want |= {(g, f"{g}C:{c}", f"{g}C:{p}", "is_a") for c, p in isa if {c, p} <= hull}
    made = O.explanation_graphs(spark.createDataFrame(texts, "prefix long, i int, text string"), spark.createDataFrame(rows, "prefix long, entity string, concept string"), spark.createDataFrame(isa, "child string, parent string"), 2, 5)
    got = [tuple(r) for r in made.collect()]
    assert len(got) == len(want) and set(got) == want
    plan = made._jdf.queryExecution().executedPlan().toString().split("\n")
    assert [x for x in plan if "Exchange hashpartitioning" in x and "prefix" in x and "REPARTITION_BY_COL" not in x] == [] and not [x for x in plan if "SortMergeJoin" in x]


def test_trimmed_graphs_deal_nodes_and_edges_once(spark, monkeypatch):
    rng = random.Random(6)
    nodes = [(g, f"{k}{i}", kind) for g in range(6) for k, kind, n in (("S", "sentence", 5), ("E", "entity", 3)) for i in range(n)]
    edges = [(g, f"S{rng.randrange(6)}", f"{rng.choice('ES')}{rng.randrange(4)}") for g in range(7) for _ in range(14)]
    want_nodes, want_edges = [], []
    for g in range(7):
        degree = {x: sum((a == x) + (b == x) for h, a, b in edges if h == g) for h, x, _ in nodes if h == g}
        cut = sorted((x for x in degree if x[0] == "S"), key=lambda x: (-degree[x], x))[:3]
        kept = {*cut, *(x for x in degree if x[0] == "E")}
        want_nodes += [(h, x, k) for h, x, k in nodes if h == g and x in kept]
        want_edges += [(h, a, b) for h, a, b in edges if h == g and {a, b} <= kept]
    written = []
    monkeypatch.setattr(O, "settled", lambda d, n: written.append(d) or scratch.settled(d, n))
    got = O.trimmed_graphs(spark.createDataFrame(nodes, "prefix long, id string, kind string"), spark.createDataFrame(edges, "prefix long, src string, dst string"), 6)
    assert sorted(map(tuple, got[0].collect())) == sorted(want_nodes) and sorted(map(tuple, got[1].collect())) == sorted(want_edges)
    assert [d._jdf.queryExecution().executedPlan().toString().count("Exchange") for d in written] == [1]


@pytest.mark.parametrize("most", [0, 40, 60, 10_000])
def test_trimmed_graph_cuts_sentences_only(spark, most, monkeypatch):
    """Against sets; edges are settled once and not shuffled by their ends."""
    rng = random.Random(most)
    rows = [(rng.choice([None, *range(30)]), rng.choice([None, *(f"e{k}" for k in range(9))]), rng.choice([None, *(f"c{k}" for k in range(9))])) for _ in range(150)]
    isa = [(f"c{rng.randrange(14)}", f"c{rng.randrange(14)}") for _ in range(40)]
    graph = O.explanation_graph(spark.createDataFrame(rows, "sentence int, entity string, concept string"), spark.createDataFrame(isa, "child string, parent string"))
    name = lambda k, x: None if x is None else f"{k}:{x}"
    want = {(name("S", s), name("E", e), "mentions") for s, e, _ in rows} | {(name("E", e), f"C:{c}", "maps_to") for _, e, c in rows if c}
    want |= {(f"C:{a}", f"C:{b}", "is_a") for a, b in isa if a in {c for _, _, c in rows}}
    assert sorted(map(str, map(tuple, graph.collect()))) == sorted(map(str, want))
    degree = {}
    for a, b, _ in want:
        for x in (a, b):
            degree[x] = degree.get(x, 0) + 1
    fixed = {x for x in degree if x and x[0] in "CE"}
    cut = sorted(set(degree) - fixed, key=lambda x: (-degree[x], x is not None, x))[: max(0, most - len(fixed))]
    names = []
    monkeypatch.setattr(O, "settled", lambda d, n: names.append(n) or scratch.settled(d, n))
    nodes, edges = O.trimmed_graph(graph, most)
    assert {(r.id, r.degree) for r in nodes.collect()} == {(x, degree[x]) for x in fixed | set(cut)} and nodes.count() == len(fixed) + len(cut)
    kept = fixed | set(cut) - {None}
    assert sorted(map(str, map(tuple, edges.collect()))) == sorted(str(x) for x in want if x[0] in kept and x[1] in kept)
    assert names.count("graph-edges") == 1 and "Exchange hashpartitioning" not in edges._jdf.queryExecution().executedPlan().toString()
