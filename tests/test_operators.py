"""Small inputs with values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions.lexicons import HEDGES
from textloom.functions.model_json import parse_verdict
from textloom.operators import corpus as C
from textloom.operators import keyness as K
from textloom.operators import lexical as L
from textloom.operators import linking as N
from textloom.operators import ontology as O
from textloom.operators import review as R
from textloom.sources import readers, sinks

ISA = [("A", "R"), ("B", "A"), ("C", "B"), ("C", "A"), ("D", "B"), ("E", "R"), ("D", "E"), ("X", "O")]


@pytest.fixture(scope="module")
def graph(spark):
    isa = spark.createDataFrame(ISA, "child string, parent string")
    up = O.closure(isa, paths=True)
    return isa, up, O.depths(up, "R")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_tokens(spark):
    t = F.lit("The naïve co-naïve patient’s patient's x-ray Ünder may_be don't 3-4 été end")
    assert one(spark, T.term_tokens(t)) == "the co patient s patient's x-ray don't 3-4 end".split()
    assert one(spark, T.letter_tokens(t)) == "the co patient s patient s x ray don t end".split()
    assert one(spark, T.vector_tokens(t)) == "the naïve co naïve patient patient ray ünder may_be don été end".split()


def test_labels(spark):
    assert one(spark, T.slug(F.lit("Pharma / biologic & more"))) == "pharma_biologic_and_more" and one(spark, T.slug(F.lit("--"))) == "category"
    assert one(spark, T.depth_label(F.lit(5), F.lit(3))) == "A more specific by 2 levels" and one(spark, T.depth_label(F.lit(3), F.lit(3))) == "Same depth"
    assert one(spark, T.case_pair_slug(F.lit("case_012"), F.lit("case_5.txt"))) == "005_012"


def test_hedges():
    assert len(HEDGES) == 34


def test_tfidf(spark):
    docs = spark.createDataFrame([("A", 1, "pain leg pain"), ("A", 2, "pain arm"), ("A", 3, ""), ("B", 1, "pain drug"), ("B", 2, "leg drug drug"), ("B", 3, "arm leg")], "corpus string, case_id int, text string")
    got = {r.term: (r.mean_a, r.mean_b, r.gap) for r in L.tfidf_gap(docs).collect()}
    assert got["pain"] == pytest.approx((0.480313, 0.265320, 0.214993))
    assert got["leg"] == pytest.approx((0.183117, 0.350854, -0.167737))
    assert got["arm"][2] == pytest.approx(0)


def test_keyness_formula(spark):
    lit = lambda *v: [F.lit(float(x)) for x in v]
    for a, b, want in ((81, 2, 130.225), (45, 0, 81.581), (105, 45, 53.796)):
        assert one(spark, K.g2(*lit(a, b, 10061, 14812))) == pytest.approx(want, abs=1e-3)


def test_graph(graph):
    isa, up, depth = graph
    assert {r.c: r.depth for r in depth.collect()} == {"R": 0, "A": 1, "B": 2, "C": 3, "D": 3, "E": 1, "O": None, "X": None}
    assert up.where("c = 'C' and anc = 'R'").first().min_hops == 2
    pairs = isa.sparkSession.createDataFrame([("C", "D"), ("C", "E"), ("C", "A"), ("D", "E"), ("B", "E"), ("C", "X")], "ca string, cb string")
    got = {(r.ca, r.cb): (r.lca, r.depth_lca, r.hops_a, r.hops_b) for r in O.lowest_common_ancestors(pairs, up, depth).collect()}
    assert got == {("C", "D"): ("B", 2, 1, 1), ("C", "E"): ("R", 0, 2, 1), ("C", "A"): ("A", 1, 1, 0), ("D", "E"): ("E", 1, 1, 0), ("B", "E"): ("R", 0, 2, 1)}


def test_cycle_raises(spark):
    with pytest.raises(ValueError):
        O.closure(spark.createDataFrame([("a", "b"), ("b", "a")], "child string, parent string"), max_levels=4)


@pytest.mark.parametrize(
    "raw, decision, a",
    [
        ('```json\n{"decision": "KEEP", "entity_a": "x"}\n```', "KEEP", "x"),
        ('{"decision": "SUBSTITUTE", "entity_a": "x",}', "SUBSTITUTE", "x"),
        ("{“decision”: “KEEP”, “entity_a”: “x”}", "KEEP", "x"),
        ('Well: {"decision": "KEEP", "entity_a": null}', "KEEP", None),
        ('{"decision": "keep", "entity_a": "x', "KEEP", None),
        ('{"decision": "perhaps', "INCOMPARABLE", None),
    ],
)
def test_verdicts(spark, raw, decision, a):
    v = one(spark, parse_verdict(F.lit(raw)))
    assert (v.decision, v.entity_a) == (decision, a)


def test_sentence_context(spark):
    text = F.lit('He came. "The liver   was large." It was fine.')
    assert one(spark, T.surrounding_sentence(text, F.lit("liver"))) == '"The liver was large."'
    assert one(spark, T.surrounding_sentence(text, F.lit("lung"))) == ""


def test_corpus_rows(spark):
    rows = spark.createDataFrame([("[['A', 'man'], ['1', '-', 'Gout'], ['CORRECT', 'ANSWER:', '1'], ['It', \"isn't\", 'flu']]",), ("None",), ("x",), (None,)], "text string").select(C.parse_sentences(F.col("text")).alias("p"))
    got = [r.p for r in rows.collect()]
    assert [p.reason for p in got] == [None, "empty", "not a list", "empty"]
    s = rows.where("p.sentences is not null").select(C.stem(F.col("p.sentences")), C.justification(F.col("p.sentences")), C.option_number(F.col("p.sentences")), C.option_label(F.col("p.sentences"))).first()
    assert tuple(s) == ("A man\n\n1 - Gout", "It isn't flu", 1, "Gout")


def test_link_best(spark):
    d = spark.createDataFrame([("1", "Heart attack (disorder)", 0), ("1", "Heart attack", 1), ("2", "Attack", 1)], "concept string, term string, rank int")
    e = spark.createDataFrame([("heart attack",), ("attack",), ("heart",), ("foot",)], "entity string")
    assert {r.entity: r.concept for r in N.link_best(e, d).collect()} == {"heart attack": "1", "attack": "2", "heart": "1", "foot": None}


def test_release_files(spark, tmp_path):
    (tmp_path / "sct2_Description_Snapshot-en.txt").write_text('id\tactive\tconceptId\tlanguageCode\ttypeId\tterm\n1\t1\t10\ten\t900000000000003001\tPain "x"\n2\t1\t10\ten\t900000000000013009\tAche\n3\t0\t10\ten\t900000000000013009\tOld\n')
    (tmp_path / "sct2_Relationship_Snapshot.txt").write_text("id\tactive\tsourceId\tdestinationId\ttypeId\n1\t1\t10\t20\t116680003\n2\t0\t10\t30\t116680003\n3\t1\t10\t40\t5\n")
    assert {(r.term, r["rank"]) for r in readers.rf2_descriptions(spark, str(tmp_path)).collect()} == {('Pain "x"', 0), ("Ache", 1)}
    assert [tuple(r) for r in readers.rf2_isa(spark, str(tmp_path)).collect()] == [("10", "20")]


def test_case_list_and_sinks(spark, tmp_path):
    (tmp_path / "list.txt").write_text("case_001.txt\n002 # two\n3\n# none\n")
    assert {r.case_num for r in readers.case_list(spark, str(tmp_path / "list.txt")).collect()} == {1, 2, 3}
    df = spark.createDataFrame([("a", None)], "x string, y string")
    sinks.write_csv(df, str(tmp_path / "csv"), single=True)
    assert readers.csv_table(spark, str(tmp_path / "csv"), "x string, y string").collect() == df.collect()
    sinks.write_graphml(spark.createDataFrame([("n<1", "concept")], "id string, kind string"), spark.createDataFrame([("n<1", "n<1", "is_a")], "src string, dst string, rel string"), str(tmp_path / "g"))
    assert "n&lt;1" in "".join(p.read_text() for p in (tmp_path / "g").glob("part*"))


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_gazetteer_takes_terms_from_left_to_right(spark):
    docs = frame(spark, [("A", 1, "a b c d e f"), ("A", 2, None), ("A", 3, "")], "corpus string, case_id long, text string")
    terms = frame(spark, [("a b c",), ("c d e",), ("e f",)], "term string")
    got = N.gazetteer_entities(docs, terms).collect()
    assert sorted((r.pos, r.entity) for r in got) == [(0, "a b c"), (4, "e f")]


def test_entities_inside_of_words_and_of_signs(spark):
    texts = {1: "heart attack", 2: "an art attack!", 3: "vitamin b+ here", 4: "ab+c", 5: "c++ and é", 6: "x-ray vision", 7: None, 8: ""}
    docs = frame(spark, list(texts.items()), "case_id long, text string")
    asked = ["art attack", "b+", "++", "é", "x-", "ray", "-ray v", "heart", "", None]
    got = N.entity_cases(docs, frame(spark, [(e,) for e in asked], "entity string")).collect()
    found = {}
    for r in got:
        found.setdefault(r.entity, set()).add(r.case_id)
    # the blank makes a substring, everything else is looked for between letters and digits; a hyphen makes a substring, too
    assert found == {"art attack": {1, 2}, "b+": {3}, "é": {5}, "x-": {6}, "ray": {6}, "-ray v": {6}, "heart": {1}}
    first = {r.entity: r.case_id for r in N.first_case(docs, frame(spark, [(e,) for e in asked], "entity string")).collect()}
    assert first["art attack"] == 1 and "++" not in first


def test_sentences_around_entities(spark):
    rows = [
        ("One. He said (see pain!) Two pains hurt. Three", "pains", ") Two pains hurt."),
        ('He left "now." Then came Pain? No', "pain", '" Then came Pain?'),
        ("no end of\n a   sentence here", "sentence", "no end of a sentence here"),
        ("v1.5 of x is out. Bye", "x", "v1.5 of x is out."),
        ("nothing", "pain", ""), (None, "pain", ""), ("pain", "", ""), ("pain " * 100, "pain", ("pain " * 100)[:319] + "…"),
    ]
    df = frame(spark, [(i, t, e) for i, (t, e, _) in enumerate(rows)], "i int, text string, entity string")
    got = {r.i: r.s for r in df.select("i", T.surrounding_sentence(F.col("text"), F.col("entity")).alias("s")).collect()}
    assert got == {i: s for i, (_, _, s) in enumerate(rows)}
    spans = {r.i: r.s for r in df.select("i", T.entity_span(F.col("text"), F.col("entity")).alias("s")).collect()}
    assert tuple(spans[0]) == (29, 34) and spans[4] is None


def test_excerpts_of_seeds(spark):
    docs = frame(spark, [("A", "c1", "pain of a kind"), ("B", "c1", " severe ache "), ("A", "c2", "pain again"), ("B", "c3", "odd ache " * 200)], "corpus string, case_id string, text string")
    seeds = frame(spark, [(None, "pain", "ache", "x", "y"), ("c1", "pain", "ache", "", None), ("", "pain", "ache", "", ""), (None, "again", "odd", "", ""), ("c1|c2", "pain", "ache", None, None), ("c9", "a", "b", "", "")], "case_id string, entity_a string, entity_b string, excerpt_a string, excerpt_b string")
    got = [tuple(r) for r in R.review_excerpts(seeds, docs).orderBy("entity_a", "entity_b", "case_id", "excerpt_a").collect()]
    bar = "(no single shared case file; stems split — excerpts omitted)"
    assert got == [
        ("c9", "a", "b", "", ""), (None, "again", "odd", "pain again", ("odd ache " * 200)[:900] + "…"), (None, "pain", "ache", "x", "y"), ("c1", "pain", "ache", "pain of a kind", "severe ache"), ("c1", "pain", "ache", "pain of a kind", "severe ache"), ("c1|c2", "pain", "ache", bar, bar),
    ]


def test_graph_hull_keeps_seeds_and_links(spark):
    isa = frame(spark, [("a", "p"), ("b", "p"), ("p", "q"), ("q", "r")], "child string, parent string")
    linked = frame(spark, [("1", "pain", "a"), ("1", "ache", "b"), ("2", "pain", "a"), ("2", "odd", None)], "prefix string, entity string, concept string")
    parts = O.split_sentences(frame(spark, [("1", "Pain here. No ache!  "), ("2", "Painful.")], "prefix string, text string"))
    assert sorted(map(tuple, parts.collect())) == [("1", 0, "Pain here."), ("1", 1, "No ache!"), ("2", 0, "Painful.")]
    edges = {tuple(r)[1:] for r in O.explanation_graphs(parts, linked, isa, 2, 3).collect()}
    assert edges == {("1S0", "1E:pain", "mentions"), ("1S1", "1E:ache", "mentions"), ("1E:pain", "1C:a", "maps_to"), ("1E:ache", "1C:b", "maps_to"), ("2E:pain", "2C:a", "maps_to"), ("1C:a", "1C:p", "is_a"), ("1C:b", "1C:p", "is_a"), ("2C:a", "2C:p", "is_a"), ("2C:p", "2C:q", "is_a")}
    assert {r.concept for r in O.concept_hull(linked.where("prefix = '1'"), isa, 2, 1).collect()} == {"a", "b"}


def test_neighbourhood_attributes(spark):
    isa = frame(spark, [("a", "p"), ("p", "q")], "child string, parent string")
    seeds = frame(spark, [("a", 2, "A"), ("a", 1, "B"), ("p", 1, "A")], "concept string, case_id long, side string")
    nodes, edges = O.neighbourhood_graph(seeds, isa, frame(spark, [("a", "label a")], "concept string, label string"))
    assert {tuple(r) for r in nodes.collect()} == {("a", "concept", "label a", "a", "A,B", "1+2"), ("p", "concept", "p", "p", "A", "1"), ("q", "concept", "q", "q", "", "")}
    assert edges.count() == 2


def test_samples_top_up_or_raise(spark):
    rows = frame(spark, [(i, "x" if i < 3 else "general") for i in range(20)], "case_id long, area string")
    got = C.stratified_sample(rows, {"x": 5, "general": 4}, top_up="general").groupBy("area").count().collect()
    assert {r.area: r["count"] for r in got} == {"x": 3, "general": 6}
    with pytest.raises(ValueError, match="fewer than 30"):
        C.stratified_sample(rows, {"x": 5}, top_up="general", total=30)


def test_judge_says_what_failed(spark):
    bundles = frame(spark, [(1, "{}"), (2, "{}")], "case_id long, record string")

    def provider(prompt):
        raise RuntimeError("down")

    assert {r.judgement.verdict for r in R.judge(bundles, provider).collect()} == {"error"}
    assert {r.raw for r in R.judge(bundles, None).collect()} == {'{"skipped": "dry_run"}'}


def test_overview_takes_each_key_once(spark):
    rows = frame(spark, [("KEEP", 1, "k"), ("KEEP", 2, "k"), ("KEEP", 3, "m"), ("OTHER", 4, "n")], "decision string, place int, pair string")
    got = R.capped_by_decision(rows, {"KEEP": 2}, ["place"], ["pair"]).collect()
    assert sorted((r.place, r.pair) for r in got) == [(1, "k"), (3, "m")]


def test_dataset_warns_of_odd_counts(spark, tmp_path):
    frame(spark, [("b", "t", 2), ("a", None, 1)], "id string, text string, place int").write.parquet(str(tmp_path / "d"))
    with pytest.warns(UserWarning, match="125 rows were expected"):
        got = readers.dataset(spark, str(tmp_path / "d"), order="place", expected_rows=125)
    assert sorted(map(tuple, got.collect())) == [(1, "a", None), (2, "b", "t")]


def test_keyness_ranks_alike_with_and_without_a_limit(spark):
    docs = frame(spark, [("A", 1, "a a a b c d d"), ("A", 2, "e f"), ("B", 1, "a x y z")], "corpus string, case_id long, text string")
    every, first = K.keyness(docs, top=None), K.keyness(docs, top=3)
    assert every.columns == first.columns
    ranks = {r.term: r["rank"] for r in every.collect()}
    assert ranks["d"] == 1 and {ranks[t] for t in "bcef"} == {2} and {r.term: r["rank"] for r in first.collect()} == {t: r for t, r in ranks.items() if r <= 3}
