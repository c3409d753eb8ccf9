"""A source of ontology release files that chooses files by release and rows by type before anything reaches Spark.

Tab-separated files named like ``sct2_Description_Snapshot-en_X.txt`` lie anywhere below a folder. Each is read by ranges of bytes, by
column names of its own header, and only the asked-for columns are made. Pushed filters on ``release`` and ``file`` drop whole
files, those on the files' columns drop rows while reading. Filters are pushed with the option ``pushFilters``, where the session has
spark.sql.python.filterPushdown.enabled; else Spark applies them itself, with the same rows."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith
from pyspark.sql.types import StructType

from textloom.sources.files import opened

#: The columns of release files, by the kind of their rows.
COLUMNS = {
    "description": ["id", "effectiveTime", "active", "moduleId", "conceptId", "languageCode", "typeId", "term", "caseSignificanceId"],
    "relationship": ["id", "effectiveTime", "active", "moduleId", "sourceId", "destinationId", "relationshipGroup", "typeId", "characteristicTypeId", "modifierId"],
}
#: Columns that a file must have to be read at all.
NEEDED = {"description": ["conceptId", "languageCode", "typeId", "term", "active"], "relationship": ["sourceId", "destinationId", "typeId", "active"]}
RELEASES = ("Snapshot", "Delta", "Full")


@dataclass
class Range(InputPartition):
    path: str
    release: str
    start: int
    end: int
    header: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        super().__init__(self.path)


def kind_of(name: str) -> str | None:
    low = name.lower()
    if not low.startswith("sct2_") or not low.endswith(".txt"):
        return None
    if low.startswith("sct2_description"):
        return "description"
    return "relationship" if "relationship" in low and "concrete" not in low else None


def release_of(name: str) -> str | None:
    """Snapshot, Delta or Full, as the part of the name after the kind begins."""
    return next((r for r in RELEASES if re.search(rf"(?:_|Description|Relationship){r}", name, re.IGNORECASE)), None)


class ReleaseReader(DataSourceReader):
    def __init__(self, path: str, kind: str, range_bytes: int, schema: StructType):
        self.path, self.kind, self.range_bytes, self.schema = path, kind, range_bytes, schema
        self.file_filters: list[Filter] = []
        self.row_filters: list[Filter] = []

    @staticmethod
    def _holds(f: Filter, value: str | None) -> bool:
        if value is None or isinstance(f, IsNotNull):
            return value is not None
        return value == f.value if isinstance(f, EqualTo) else value in f.value if isinstance(f, In) else value.startswith(f.value)

    def partitions(self) -> list[Range]:
        files, root = opened(self.path)
        out = []
        for info in files.get_file_info(fs.FileSelector(root, recursive=True)):
            if info.type != fs.FileType.File or kind_of(info.base_name) != self.kind or not info.size:
                continue
            release = release_of(info.base_name)
            values = {"release": release, "file": info.base_name}
            if not all(self._holds(f, values[f.attribute[0]]) for f in self.file_filters):
                continue
            with files.open_input_file(info.path) as source:
                head = _line(source, 0)
            names = head.decode("utf-8", "replace").lstrip("﻿").rstrip("\r\n").split("\t")
            if not set(NEEDED[self.kind]) <= set(names):
                continue
            out += [Range(info.path, release, a, min(a + self.range_bytes, info.size), names) for a in range(len(head), info.size, self.range_bytes)]
        return out or [Range("", None, 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        """The lines that begin within the range."""
        if not part.path:
            return
        files, _ = opened(self.path)
        with files.open_input_file(part.path) as source:
            at = part.start + (len(_line(source, part.start - 1)) - 1 if source.read_at(1, part.start - 1) != b"\n" else 0)
            while at < part.end:
                raw = source.read_at(min(4 << 20, part.end - at), at)
                if not raw.endswith(b"\n"):
                    raw += _line(source, at + len(raw))
                at += len(raw)
                yield from self._batches(raw, part)

    def _batches(self, raw: bytes, part: Range) -> Iterator[pa.RecordBatch]:
        try:
            raw.decode()
        except UnicodeDecodeError:
            raw = raw.decode("utf-8", "replace").encode()
        # short lines have no values for the columns that are asked for, and are left out; what follows the last column is cut off
        n = len(part.header)
        mend: list[bytes] = []

        def odd(row: pyarrow.csv.InvalidRow) -> str:
            if row.actual_columns > n:
                mend.append("\t".join(row.text.split("\t")[:n]).encode())
            return "skip"

        options = {
            "read_options": pyarrow.csv.ReadOptions(column_names=part.header, use_threads=False, block_size=max(1 << 20, 2 * len(raw))),
            "parse_options": pyarrow.csv.ParseOptions(delimiter="\t", quote_char=False, double_quote=False, ignore_empty_lines=True, invalid_row_handler=odd),
            "convert_options": pyarrow.csv.ConvertOptions(column_types=dict.fromkeys(part.header, pa.string()), strings_can_be_null=False),
        }
        if not raw.strip(b"\r\n"):
            return
        tables = [pyarrow.csv.read_csv(pa.BufferReader(raw), **options)]
        if mend:
            tables.append(pyarrow.csv.read_csv(pa.BufferReader(b"\n".join(mend) + b"\n"), **options))
        for table in tables:
            for f in self.row_filters:
                column = f.attribute[0]
                if column not in part.header:
                    table = table.slice(0, 0)
                    continue
                have = table.column(column)
                if isinstance(f, IsNotNull):
                    continue
                keep = pc.equal(have, f.value) if isinstance(f, EqualTo) else pc.is_in(have, pa.array(list(f.value), pa.string())) if isinstance(f, In) else pc.starts_with(have, f.value)
                table = table.filter(keep)
            none = pa.nulls(len(table), pa.string())
            fixed = {"release": pa.array([part.release] * len(table), pa.string()), "file": pa.array([part.path.rsplit("/", 1)[-1]] * len(table), pa.string())}
            columns = [fixed[f.name] if f.name in fixed else table.column(f.name) if f.name in part.header else none for f in self.schema.fields]
            yield from pa.table(columns, names=self.schema.fieldNames()).to_batches()


class PushingReader(ReleaseReader):
    """Spark refuses a reader that takes filters while the session doesn't push them, so this is a class of its own."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if isinstance(f, (EqualTo, In, StringStartsWith, IsNotNull)) and column in ("release", "file"):
                self.file_filters.append(f)
            elif isinstance(f, (EqualTo, In, StringStartsWith, IsNotNull)) and column in COLUMNS[self.kind]:
                self.row_filters.append(f)
            else:
                yield f


def _line(source: pa.NativeFile, at: int) -> bytes:
    """The bytes from ``at`` to the end of its line."""
    out = b""
    while chunk := source.read_at(1 << 16, at + len(out)):
        end = chunk.find(b"\n")
        if end >= 0:
            return out + chunk[: end + 1]
        out += chunk
    return out


class Release(DataSource):
    """``spark.read.format("ontology_release").option("kind", "description").load(folder)``; ``rangeBytes`` sizes the partitions,
    ``pushFilters`` takes filters."""

    @classmethod
    def name(cls) -> str:
        return "ontology_release"

    def schema(self) -> str:
        return ", ".join(f"{c} string" for c in ["release", "file", *COLUMNS[self.options["kind"]]])

    def reader(self, schema: StructType) -> ReleaseReader:
        kind = PushingReader if self.options.get("pushFilters", "false").lower() == "true" else ReleaseReader
        return kind(self.options["path"], self.options["kind"], int(self.options.get("rangeBytes", 64 << 20)), schema)
