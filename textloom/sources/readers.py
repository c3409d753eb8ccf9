"""Sources: corpus folders, datasets, ontology releases, case lists, CSV tables."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import lexicons
from textloom.operators.lexical import fully_ranked
from textloom.sources.release import Release


def _named_files(spark: SparkSession, path: str, glob: str, recursive: bool = False) -> DataFrame:
    """(folder, name, bytes): whole files, the name without its ending."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", recursive).load(path)
    # the path is a URI in which a plus sign stands for itself
    part = lambda k: F.url_decode(F.replace(F.get(F.split("path", "/"), F.size(F.split("path", "/")) + k), F.lit("+"), F.lit("%2B")))
    return rows.select(part(-2).alias("folder"), F.regexp_replace(part(-1), r"\.[^.]*$", "").alias("name"), F.col("content").alias("bytes"))


def decoded(content: Column, errors: str = "strict") -> Column:
    """Bytes as UTF-8 text. "strict" raises on bytes that are none, "replace" puts U+FFFD for them."""
    text = content.cast("string")
    return {"strict": F.validate_utf8, "replace": F.make_valid_utf8}[errors](text)


def corpus_folder(spark: SparkSession, path: str, corpus: str, glob: str = "case_*.txt", errors: str = "strict") -> DataFrame:
    """docs(corpus, case_id, text): one text file is one case, named by its file. Spark passes over empty files: they are no cases.

    ``errors`` says what becomes of bytes that aren't UTF-8: "strict" raises, "replace" puts U+FFFD, "skip" leaves such files
    to ``corpus_rejects``."""
    rows = _named_files(spark, path, glob)
    if errors == "skip":
        rows, errors = rows.where(F.is_valid_utf8(F.col("bytes").cast("string"))), "replace"
    return rows.select(F.lit(corpus).alias("corpus"), F.col("name").alias("case_id"), decoded(F.col("bytes"), errors).alias("text"))


def corpus_rejects(spark: SparkSession, path: str, corpus: str, glob: str = "case_*.txt") -> DataFrame:
    """(corpus, case_id, n_bytes): the files that aren't UTF-8."""
    rows = _named_files(spark, path, glob).where(~F.is_valid_utf8(F.col("bytes").cast("string")))
    return rows.select(F.lit(corpus).alias("corpus"), F.col("name").alias("case_id"), F.octet_length("bytes").alias("n_bytes"))


def read_cases(spark: SparkSession, path: str, errors: str = "strict") -> DataFrame:
    """docs(corpus, case_id, text) as written by ``write_cases``: corpora are folders, cases their text files."""
    rows = _named_files(spark, path, "*.txt", recursive=True)
    return rows.select(F.col("folder").alias("corpus"), F.col("name").alias("case_id"), decoded(F.col("bytes"), errors).alias("text"))


def dataset(spark: SparkSession, path: str, fmt: str = "parquet", order: str | None = None, expected_rows: int | None = None) -> DataFrame:
    """Rows (id, text) of a dataset's files; with ``order``, also case_num from 1 in the order of that column. Another count than expected warns."""
    raw = spark.read.format(fmt).load(path)
    if expected_rows is not None and (n := raw.count()) != expected_rows:
        warnings.warn(f"{expected_rows} rows were expected, {n} found", stacklevel=2)
    if order is None:
        return raw.select("id", "text")
    ranked = fully_ranked(raw.select("id", "text", F.col(order).alias("_order"), F.lit(0).alias("_all")), "_all", [F.col("_order"), F.col("id")], "case_num")
    return ranked.select("case_num", "id", "text")


def conversations(spark: SparkSession, path: str, sides={"user": "A", "assistant": "B"}) -> DataFrame:
    """docs(corpus, case_id, text): each conversation's turns of a role, joined in order."""
    side = F.lit(None)
    for role, corpus in sides.items():
        side = F.when(F.col("role") == role, corpus).otherwise(side)
    rows = spark.read.parquet(path).where(F.col("role").isin(*sides)).select(side.alias("corpus"), F.col("conv_id").alias("case_id"), "turn", "text")
    turns = rows.groupBy("corpus", "case_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return turns.select("corpus", "case_id", F.array_join("t.text", "\n").alias("text"))


def release_rows(spark: SparkSession, root: str, kind: str, release: str = "Snapshot", range_bytes: int = 64 << 20) -> DataFrame:
    """(release, file, and the files' columns) of a release folder's descriptions or relationships; ``release`` "all" has those of every release.

    Filters on release, active, typeId and the like are applied while files are chosen and read, where the session lets them be pushed
    (spark.sql.python.filterPushdown.enabled). Files without the needed columns are passed over, as are lines that are too short."""
    spark.dataSource.register(Release)
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    rows = spark.read.format(Release.name()).option("pushFilters", push).option("kind", kind).option("rangeBytes", range_bytes).load(root)
    return rows if release == "all" else rows.where(F.col("release") == release)


def rf2_descriptions(spark: SparkSession, root: str, release: str = "Snapshot") -> DataFrame:
    """(concept, term, rank): active English names; rank 0 full names, 1 synonyms. ``release`` "all" mixes the releases."""
    rows = release_rows(spark, root, "description", release).where((F.col("active") == "1") & F.col("typeId").isin(lexicons.FSN, lexicons.SYNONYM))
    rows = rows.where(F.lower(F.trim("languageCode")).startswith("en")).where("trim(term) <> ''")
    return rows.select(F.col("conceptId").alias("concept"), F.trim("term").alias("term"), F.when(F.col("typeId") == lexicons.FSN, 0).otherwise(1).alias("rank"))


def rf2_isa(spark: SparkSession, root: str, release: str = "Snapshot") -> DataFrame:
    """isa(child, parent) of the active is-a relationships."""
    rows = release_rows(spark, root, "relationship", release).where((F.col("active") == "1") & (F.col("typeId") == lexicons.IS_A))
    return rows.select(F.col("sourceId").alias("child"), F.col("destinationId").alias("parent")).distinct()


def labels(descriptions: DataFrame, wanted: DataFrame) -> DataFrame:
    """(concept, label): the best lower-case name of each wanted concept; the wanted set reaches the scan as a semi-join."""
    rows = descriptions.join(wanted.select("concept").distinct(), "concept", "left_semi")
    return rows.groupBy("concept").agg(F.min(F.struct("rank", F.lower("term").alias("term")))["term"].alias("label"))


def csv_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema, nullValue="", quote='"', escape='"', multiLine=True)


def last_row_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("x")).select("x.*")


def case_list(spark: SparkSession, path: str) -> DataFrame:
    """(case_num): case_001.txt, 001 or 1 on a line; # starts a comment."""
    rows = spark.read.text(path).select(F.regexp_extract(F.regexp_replace("value", "#.*$", ""), r"^\s*(?:case_)?0*(\d+)(?:\.txt)?\s*$", 1).try_cast("int").alias("case_num"))
    return rows.where("case_num is not null").distinct()


def seeds(rows: DataFrame, max_rows: int = 0, seed: int = 42) -> DataFrame:
    """Seeds (case_id, entity_a, entity_b, kind, excerpt_a, excerpt_b) of either kind in one form: tables with entity_a and entity_b, or with one
    entity for both sides; excerpts are the tables' contexts, if they have any. With ``max_rows`` a sample by the order of md5."""
    both = {"entity_a", "entity_b"} <= set(rows.columns)
    name = lambda s: F.col(f"entity_{s}" if both else "entity").alias(f"entity_{s}")
    context = lambda s: (F.coalesce(f"context_sentence_{s}", F.lit("")) if f"context_sentence_{s}" in rows.columns else F.lit("")).alias(f"excerpt_{s}")
    made = rows.select("case_id", name("a"), name("b"), F.lit("hierarchical" if both else "same string").alias("kind"), context("a"), context("b"))
    if max_rows <= 0:
        return made
    key = F.concat_ws("|", "case_id", "entity_a", "entity_b", F.lit(str(seed)))
    return made.orderBy(F.md5(key.cast("binary")), "case_id", "entity_a", "entity_b").limit(max_rows)
