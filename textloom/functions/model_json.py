"""Tolerant parsing of a model's JSON verdicts, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VERDICT = "decision string, entity_a string, entity_b string, rationale string"
DECISIONS = ("KEEP", "SUBSTITUTE", "INCOMPARABLE")


def _unfenced(raw: Column) -> Column:
    inner = F.regexp_extract(raw, r"(?is)```(?:json)?\s*(.*)```", 1)
    return F.trim(F.when(inner != "", inner).otherwise(raw))


def _no_trailing_commas(blob: Column) -> Column:
    return F.regexp_replace(blob, r",+(\s*[}\]])", "$1")


def _straight_quotes(blob: Column) -> Column:
    return F.translate(blob, "“”‘’", "\"\"''")


def _field(raw: Column, name: str) -> Column:
    value = F.regexp_extract(raw, rf'(?is)"{name}"\s*:\s*"((?:\\.|[^"\\])*)"', 1)
    return F.when(value != "", F.regexp_replace(F.regexp_replace(value, r"\\n", " "), r"\\(.)", "$1"))


def parse_verdict(raw: Column) -> Column:
    """struct(decision, entity_a, entity_b, rationale): strict JSON, then repairs, then single fields.

    An object without a decision keeps it null; an unknown or missing decision of salvaged text is INCOMPARABLE."""
    blob = F.regexp_extract(_unfenced(raw), r"(?s)(\{.*\})", 1)
    tries = [blob, _no_trailing_commas(blob), _straight_quotes(blob), _no_trailing_commas(_straight_quotes(blob))]
    parsed = [F.from_json(t, VERDICT, {"mode": "PERMISSIVE"}) for t in tries]
    quoted = F.regexp_extract(raw, r"(?is)\"decision\"\s*:\s*'([^']*)'", 1)
    decision = F.upper(F.trim(F.coalesce(_field(raw, "decision"), quoted, F.lit(""))))
    salvaged = F.struct(
        F.when(decision.isin(*DECISIONS), decision).otherwise("INCOMPARABLE").alias("decision"),
        _field(raw, "entity_a").alias("entity_a"),
        _field(raw, "entity_b").alias("entity_b"),
        F.coalesce(_field(raw, "rationale"), F.lit("salvaged from text that is no JSON")).alias("rationale"),
    )
    return F.coalesce(*(F.when(F.json_object_keys(t).isNotNull(), p) for t, p in zip(tries, parsed)), salvaged)
