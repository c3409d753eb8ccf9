"""A sink of one text file for each case, ``<path>/<corpus>/case_007.txt``, that changes a folder as a whole or not at all.

Tasks write into a staging folder beside the cases. Only when all have ended are files moved to their places and stale ones
deleted; a failed write leaves the folder as it was. Nothing but the tasks' folder names goes through the driver."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import BinaryType, StringType, StructType

from textloom.sources.files import opened, remove

STAGING = "_staging-"
#: Names of cases whose files go, one on a line.
STALE = "_stale"


def case_name(case_id: object) -> str:
    """Numbers have three digits or more, as in case_007; other ids stand as they are."""
    name = str(case_id)
    name = f"case_{int(name):03d}" if name.isascii() and name.isdigit() else name
    if not name or name[0] in "._" or "/" in name or "\n" in name or "\0" in name:
        raise ValueError(f"{case_id!r} can't name a file")
    return f"{name}.txt"


@dataclass
class Staged(WriterCommitMessage):
    folder: str


class CaseWriter(DataSourceWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool):
        kinds = {f.name: f.dataType for f in schema.fields}
        if set(kinds) != {"corpus", "case_id", "text"} or not isinstance(kinds["text"], (StringType, BinaryType)):
            raise ValueError("case files are written from (corpus, case_id, text), text being a string or binary")
        self.path, self.overwrite, self.run = path, overwrite, f"{STAGING}{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Staged:
        """A row with a null text asks for its file to be deleted; with a null corpus, too, for that of every corpus."""
        files, root = opened(self.path)
        # each attempt has a folder of its own: what a lost one has left is never moved
        folder = f"{root}/{self.run}/{uuid.uuid4().hex}"
        files.create_dir(folder)
        stale: list[str] = []
        seen: set[str] = set()
        for row in iterator:
            name = case_name(row.case_id)
            if row.text is None:
                stale.append(f"{corpus_name(row.corpus)}/{name}" if row.corpus is not None else name)
                if len(stale) >= 10_000:
                    self._note(files, folder, stale)
                continue
            own = f"{folder}/{corpus_name(row.corpus)}"
            if own not in seen:
                files.create_dir(own)
                seen.add(own)
            target = f"{own}/{name}"
            if files.get_file_info(target).type != fs.FileType.NotFound:
                raise ValueError(f"{row.corpus}/{name} is written twice")
            with files.open_output_stream(target) as out:
                out.write(row.text.encode() if isinstance(row.text, str) else bytes(row.text))
        self._note(files, folder, stale)
        return Staged(folder)

    @staticmethod
    def _note(files: fs.FileSystem, folder: str, stale: list[str]) -> None:
        if stale:
            with files.open_output_stream(f"{folder}/{STALE}-{uuid.uuid4().hex}") as out:
                out.write("".join(f"{x}\n" for x in stale).encode())
            stale.clear()

    def commit(self, messages: list[Staged | None]) -> None:
        """Folder by folder: deletions first, so that a case that is deleted and written in the same write stays."""
        files, root = opened(self.path)
        folders = [m.folder for m in messages if m is not None]
        if self.overwrite:
            for corpus in self._corpora(files, root):
                files.delete_dir(corpus)
        for folder in folders:
            for note in files.get_file_info(fs.FileSelector(folder)):
                if note.base_name.startswith(f"{STALE}-"):
                    with files.open_input_stream(note.path) as lines:
                        for name in lines.read().decode().splitlines():
                            for path in [f"{root}/{name}"] if "/" in name else [f"{c}/{name}" for c in self._corpora(files, root)]:
                                if files.get_file_info(path).type == fs.FileType.File:
                                    files.delete_file(path)
        for folder in folders:
            for corpus in files.get_file_info(fs.FileSelector(folder)):
                if corpus.type == fs.FileType.Directory:
                    files.create_dir(f"{root}/{corpus.base_name}")
                    for case in files.get_file_info(fs.FileSelector(corpus.path)):
                        files.move(case.path, f"{root}/{corpus.base_name}/{case.base_name}")
        remove(files, f"{root}/{self.run}")

    def abort(self, messages: list[Staged | None]) -> None:
        files, root = opened(self.path)
        remove(files, f"{root}/{self.run}")

    @staticmethod
    def _corpora(files: fs.FileSystem, root: str) -> list[str]:
        found = files.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return [f.path for f in found if f.type == fs.FileType.Directory and not f.base_name.startswith("_")]


def corpus_name(corpus: object) -> str:
    name = "" if corpus is None else str(corpus)
    if not name or name[0] in "._" or "/" in name or "\n" in name:
        raise ValueError(f"{corpus!r} can't name a folder")
    return name


class CaseFiles(DataSource):
    """``df.write.format("case_files").mode("append").save(path)``; with mode "overwrite" all earlier cases go."""

    @classmethod
    def name(cls) -> str:
        return "case_files"

    def schema(self) -> str:
        return "corpus string, case_id string, text string"

    def writer(self, schema: StructType, overwrite: bool) -> CaseWriter:
        return CaseWriter(self.options["path"], schema, overwrite)
