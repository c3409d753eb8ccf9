"""Entities of texts and their links to a dictionary of concept descriptions (concept, term, rank)."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import contains_entity, index_words, surrounding_sentence, term_tokens
from textloom.plans.scratch import settled


#: Entities that texts hold as a word only, never inside of one.
WHOLE_WORD = "entity rlike '^[a-z0-9]{2,}$'"


def best_terms(descriptions: DataFrame) -> DataFrame:
    """(term, concept): lower-case term; lower rank first (full names before synonyms), then the smaller concept."""
    rows = descriptions.select(F.lower(F.trim("term")).alias("term"), "concept", "rank").where("term <> ''")
    return rows.groupBy("term").agg(F.min(F.struct("rank", "concept"))["concept"].alias("concept"))


def link_exact(entities: DataFrame, descriptions: DataFrame) -> DataFrame:
    return entities.join(best_terms(descriptions), F.lower("entity") == F.col("term"), "left").drop("term")


def link_best(entities: DataFrame, descriptions: DataFrame, most_union: int = 250_000) -> DataFrame:
    """(entity, concept): the exact term, else the best description that holds the entity.

    Candidates share all of the entity's words that any description has; without such, they share any of them, or, where these are
    more than ``most_union``, the rarest. Best: rank, then shortest term, then term and concept.

    An entity meets the postings of its rarest word only; the others are looked up in the description's own words. Postings of
    frequent words that are the rarest of no entity are left out before anything is shuffled."""
    asked = entities.select(F.lower("entity").alias("entity")).distinct()
    exact = asked.join(best_terms(descriptions).withColumnRenamed("term", "entity"), "entity", "left")
    d = descriptions.select(F.lower(F.trim("term")).alias("term"), "concept", "rank").where("term <> ''").distinct()
    postings = d.withColumn("words", F.array_distinct(index_words(F.col("term")))).withColumn("word", F.explode("words"))
    counts = settled(postings.groupBy("word").agg(F.count("*").alias("n")), "posting-lengths")
    words = exact.where("concept is null").select("entity", F.explode(F.array_distinct(index_words(F.col("entity")))).alias("word")).join(counts, "word")
    rare = F.min(F.struct("n", "word"))
    open_ = settled(words.groupBy("entity").agg(F.collect_set("word").alias("known"), rare["word"].alias("rarest"), F.max("n").alias("longest")), "entity-words")

    def of_words(rows: DataFrame, word: str) -> DataFrame:
        """``rows`` with the postings of their ``word``. At most 10,000 words have a ten-thousandth of all postings, so those are sent to all tasks."""
        total = counts.agg(F.sum("n")).first()[0] or 0
        idle = counts.where(F.col("n") * 10_000 > total).join(rows.select(F.col(word).alias("word")), "word", "left_anti").select("word")
        return rows.withColumn("word", F.col(word)).join(postings.join(F.broadcast(idle), "word", "left_anti"), "word")

    holds = contains_entity(F.col("term"), F.col("entity"))
    best = lambda cond: F.min(F.when(cond, F.struct("rank", F.length("term").alias("size"), "term", "concept")))
    whole = F.size(F.array_except("known", "words")) == 0
    first = settled(of_words(open_, "rarest").groupBy("entity").agg(F.max(whole).alias("any_whole"), best(whole & holds).alias("whole"), best(holds).alias("rare")), "rarest-word")
    apart = open_.join(first.where("not any_whole"), "entity", "left_semi").where(F.col("longest") <= most_union)
    any_ = of_words(apart.select("entity", F.explode("known").alias("own")), "own").select("entity", "term", "concept", "rank").distinct()
    any_ = any_.groupBy("entity").agg(F.count("*").alias("n_any"), best(holds).alias("any"))
    pick = F.when(F.col("any_whole"), F.col("whole")).when(F.col("n_any") <= most_union, F.col("any")).otherwise(F.col("rare"))
    found = first.join(any_, "entity", "left").select("entity", pick["concept"].alias("found"))
    return exact.join(found, "entity", "left").select("entity", F.coalesce("concept", "found").alias("concept"))


def gazetteer_entities(docs: DataFrame, terms: DataFrame, most_words: int = 5) -> DataFrame:
    """(corpus, case_id, entity, pos): from left to right the longest dictionary term at each token that no earlier one taken covers.

    Every n-gram up to ``most_words`` meets the terms by equi-join; one fold over a case's sorted hits takes or leaves them."""
    words = docs.select("corpus", "case_id", term_tokens(F.col("text")).alias("w")).select("corpus", "case_id", "w", F.posexplode("w").alias("pos", "t"))
    grams = F.transform(F.sequence(F.lit(1), F.least(F.lit(most_words), F.size("w") - F.col("pos"))), lambda n: F.struct(n.alias("n"), F.array_join(F.slice("w", F.col("pos") + 1, n), " ").alias("gram")))
    rows = words.select("corpus", "case_id", "pos", F.explode(grams).alias("g")).select("corpus", "case_id", "pos", "g.n", F.col("g.gram").alias("entity"))
    hits = rows.join(terms.select(F.lower("term").alias("entity")).distinct(), "entity", "left_semi")
    longest = hits.groupBy("corpus", "case_id", "pos").agg(F.max(F.struct("n", "entity")).alias("x")).select("corpus", "case_id", "pos", "x.n", "x.entity")
    cases = longest.groupBy("corpus", "case_id").agg(F.sort_array(F.collect_list(F.struct("pos", "n", "entity"))).alias("hits"))
    taken = F.array().cast("array<struct<pos:int,n:int,entity:string>>")
    step = lambda s, h: F.when(h["pos"] >= s["reach"], F.struct((h["pos"] + h["n"]).alias("reach"), F.array_append(s["taken"], h).alias("taken"))).otherwise(s)
    kept = F.aggregate("hits", F.struct(F.lit(0).alias("reach"), taken.alias("taken")), step)["taken"]
    return cases.select("corpus", "case_id", F.explode(kept).alias("k")).select("corpus", "case_id", "k.pos", "k.entity")


def entity_depths(found: DataFrame, linked: DataFrame, depth: DataFrame) -> DataFrame:
    """(entity, corpus, frequency, concept, depth) of the entities found in each corpus."""
    counts = found.groupBy("corpus", "entity").agg(F.count("*").alias("frequency"))
    return counts.join(linked, "entity", "left").join(depth.withColumnRenamed("c", "concept"), "concept", "left").select("entity", "corpus", "frequency", "concept", "depth")


def entity_cases(docs: DataFrame, entities: DataFrame, keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """(entity, keys): the cases whose text holds the entity, by the rule of ``contains_entity``."""
    return entity_places(docs, entities, keys).distinct()


def entity_places(docs: DataFrame, entities: DataFrame, keys: tuple[str, ...] = ("case_id",), odd_too: bool = True) -> DataFrame:
    """The same, where a row may come twice. Without ``odd_too``, of entities that are whole words only.

    Whole words meet the texts' words by equi-join. What may lie inside of words, or has signs, meets the words' parts of up to three
    characters first and is looked for in the candidates' texts only; an entity without letters and digits meets the texts' characters."""
    keys_ = list(keys)
    asked = entities.select(F.lower(F.trim("entity")).alias("entity")).where("entity <> ''").distinct()
    words = docs.select(*keys_, F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)))).alias("word"))
    exact = words.join(asked.where(WHOLE_WORD), F.col("word") == F.col("entity")).select("entity", *keys_)
    if not odd_too:
        return exact
    odd = asked.where(f"not ({WHOLE_WORD})")
    runs = F.regexp_extract_all("entity", F.lit("[a-z0-9]+"), F.lit(0))
    longest = F.get(F.sort_array(F.transform(runs, lambda r: F.struct((-F.length(r)).alias("size"), r.alias("run"))))["run"], F.lit(0))
    odd = odd.withColumn("gram", F.substring(longest, 1, 3))
    sizes = F.sequence(F.lit(1), F.least(F.lit(3), F.length("word")))
    parts = F.array_distinct(F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.length("word") - n + 1), lambda i: F.substring(F.col("word"), i, n)))))
    near = words.select("word").distinct().select("word", F.explode(parts).alias("gram")).join(odd.where("gram is not null"), "gram").select("word", "entity").distinct()
    candidates = words.join(near, "word").select("entity", *keys_)
    signs = odd.where("gram is null").select("entity", F.substring("entity", 1, 1).alias("sign"))
    signed = docs.select(*keys_, F.explode(F.array_distinct(F.split(F.lower("text"), ""))).alias("sign")).join(F.broadcast(signs) if signs.isEmpty() else signs, "sign").select("entity", *keys_)
    rest = candidates.unionByName(signed).distinct().join(docs.select(*keys_, "text"), keys_)
    return exact.unionByName(rest.where(contains_entity(F.col("text"), F.col("entity"))).select("entity", *keys_))


def first_case(docs: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity, case_id): the first case whose text holds the entity."""
    return entity_cases(docs, entities).groupBy("entity").agg(F.min("case_id").alias("case_id"))


def first_shared_case(pairs: DataFrame, docs_a: DataFrame, docs_b: DataFrame) -> DataFrame:
    """pairs(entity_a, entity_b) and ``case_id``: the first case whose A text holds the one and whose B text the other; null without one."""
    asked = pairs.select(F.lower(F.trim("entity_a")).alias("a"), F.lower(F.trim("entity_b")).alias("b")).distinct()
    a = entity_cases(docs_a, asked.select(F.col("a").alias("entity"))).withColumnRenamed("entity", "a")
    b = entity_cases(docs_b, asked.select(F.col("b").alias("entity"))).withColumnRenamed("entity", "b")
    found = asked.join(a, "a").join(b, ["b", "case_id"]).groupBy("a", "b").agg(F.min("case_id").alias("case_id"))
    return pairs.join(found, (F.lower(F.trim("entity_a")) == F.col("a")) & (F.lower(F.trim("entity_b")) == F.col("b")), "left").drop("a", "b")


def with_context(rows: DataFrame, docs: DataFrame, entity_col: str, out: str, max_chars: int = 320, keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """``rows`` and ``out``: the sentence around the entity in the row's own case; empty without the case or the entity."""
    texts = docs.select(*keys, F.col("text").alias("_context"))
    met = rows.join(texts, list(keys), "left")
    return met.select(*rows.columns, surrounding_sentence(F.col("_context"), F.col(entity_col), max_chars).alias(out))


def with_pair_contexts(rows: DataFrame, docs: DataFrame, entity_a: str = "entity_a", entity_b: str = "entity_b", max_chars: int = 320) -> DataFrame:
    """``rows`` and context_sentence_a, context_sentence_b: the sentences around both entities in the A and the B text of the row's case.

    Each entity's sentence is taken once for a case, however many pairs it is in; texts meet distinct entities, never pairs. Empty
    without the text or the entity."""
    sides = {"A": entity_a, "B": entity_b}
    asked = [rows.select("case_id", F.lit(s).alias("corpus"), F.col(c).alias("entity")).distinct() for s, c in sides.items()]
    found = settled(with_context(asked[0].unionByName(asked[1]), docs, "entity", "_sentence", max_chars, keys=("corpus", "case_id")), "contexts")
    for side, column in sides.items():
        own = found.where(F.col("corpus") == side).select("case_id", F.col("entity").alias("_entity"), F.col("_sentence").alias(f"context_sentence_{side.lower()}"))
        kept = rows.columns
        rows = rows.join(own, (rows["case_id"] == own["case_id"]) & rows[column].eqNullSafe(own["_entity"]), "left").select(*[rows[c] for c in kept], f"context_sentence_{side.lower()}")
    return rows


def _frames(rows: Iterator[tuple], columns: list[str], most: int = 4_000_000) -> Iterator[pd.DataFrame]:
    """``rows`` in frames of about ``most`` bytes: a task holds one of them, however many rows a batch of texts gives."""
    part: list[tuple] = []
    size = 0
    for row in rows:
        part.append(row)
        size += 400 + 2 * sum(len(v) for v in row if isinstance(v, str))
        if size >= most:
            yield pd.DataFrame(part, columns=columns)
            part, size = [], 0
    if part:
        yield pd.DataFrame(part, columns=columns)


def recognised_entities(docs: DataFrame, load: Callable[[], Callable[[list[str]], list[list[str]]]], batch: int = 8) -> DataFrame:
    """(corpus, case_id, entity, n): lower-case names that a model finds in each text. ``load`` makes the model once in each task; it takes ``batch`` texts."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for rows in batches:
            texts = ["" if t is None else t for t in rows["text"]]
            found = (names for k in range(0, len(texts), batch) for names in model(texts[k : k + batch]))
            yield from _frames(((c, i, e) for c, i, names in zip(rows["corpus"], rows["case_id"], found) for e in (n.strip().lower() for n in names) if e), ["corpus", "case_id", "entity"])

    case = docs.schema["case_id"].dataType.simpleString()
    made = docs.select("corpus", "case_id", "text").mapInPandas(find, f"corpus string, case_id {case}, entity string")
    return made.groupBy("corpus", "case_id", "entity").agg(F.count("*").alias("n"))


#: What a model finds in a text: (entities (start, end, label), sentences (start, end)), in characters.
Found = tuple[list[tuple[int, int, str]], list[tuple[int, int]]]
SPANS = "kind string, i int, start int, end int, text string, label string"


def _by_length(texts: list[str], most: int) -> Iterator[list[str]]:
    """Runs of texts of ``most`` characters together, a longer text alone."""
    run: list[str] = []
    size = 0
    for t in texts:
        if run and size + len(t) > most:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


def recognised_spans(docs: DataFrame, load: Callable[[], Callable[[list[str]], list[Found]]], batch_chars: int = 20_000) -> DataFrame:
    """(corpus, case_id, kind, i, start, end, text, label): the sentences and entities of each text by one call of a model.

    ``load`` makes the model once in each task; it takes texts of about ``batch_chars`` characters together. A sentence has its number
    i from 0, an entity that of the sentence in which it starts (null outside of all). ``text`` is the span's own text. A null text is
    empty. ``sentences_of`` and ``entities_of`` give the rows that graphs and contexts take; settle this table first, so that both come
    from the same calls."""

    def spans_of(corpus, case, text, entities, sentences) -> Iterator[tuple]:
        bounds = sorted(sentences)
        starts = [a for a, _ in bounds]
        for i, (a, b) in enumerate(bounds):
            yield corpus, case, "sentence", i, a, b, text[a:b], None
        for a, b, label in entities:
            i = bisect_right(starts, a) - 1
            yield corpus, case, "entity", i if i >= 0 and a < bounds[i][1] else None, a, b, text[a:b], label

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for rows in batches:
            texts = ["" if t is None else t for t in rows["text"]]
            found = (f for run in _by_length(texts, batch_chars) for f in model(run))
            made = (x for corpus, case, text, f in zip(rows["corpus"], rows["case_id"], texts, found, strict=True) for x in spans_of(corpus, case, text, *f))
            for frame in _frames(made, ["corpus", "case_id", "kind", "i", "start", "end", "text", "label"]):
                yield frame.astype({"i": "Int32"})

    case = docs.schema["case_id"].dataType.simpleString()
    return docs.select("corpus", "case_id", "text").mapInPandas(find, f"corpus string, case_id {case}, {SPANS}")


def sentences_of(spans: DataFrame, corpus: str) -> DataFrame:
    """(prefix, i, text) of a corpus's sentences, as ``explanation_graphs`` takes them: a graph for each case."""
    text = F.regexp_replace("text", r"^\s+|\s+$", "")
    return spans.where((F.col("kind") == "sentence") & (F.col("corpus") == corpus)).select(F.col("case_id").alias("prefix"), "i", text.alias("text")).where("text <> ''")


def entities_of(spans: DataFrame) -> DataFrame:
    """(corpus, case_id, entity, i, sentence, n): each entity once for a sentence, with the sentence around it."""
    held = spans.where("kind = 'sentence'").select("corpus", "case_id", "i", F.col("text").alias("sentence"))
    found = spans.where("kind = 'entity'").select("corpus", "case_id", "i", F.lower(F.trim("text")).alias("entity")).where("entity <> ''")
    return found.groupBy("corpus", "case_id", "i", "entity").agg(F.count("*").alias("n")).join(held, ["corpus", "case_id", "i"], "left").select("corpus", "case_id", "entity", "i", "sentence", "n")


def depth_map(entities: DataFrame, cases: DataFrame, linked: DataFrame, depth: DataFrame) -> DataFrame:
    """(corpus, entity, depth) of the entities of the listed cases that have a depth: found(corpus, case_id, entity)."""
    own = entities.join(cases.select("case_id").distinct(), "case_id", "left_semi").select("corpus", "entity").distinct()
    return own.join(linked, "entity").join(depth.withColumnRenamed("c", "concept"), "concept").where("depth is not null").select("corpus", "entity", "depth")
