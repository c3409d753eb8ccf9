"""Sources and sinks that name, choose and decode files themselves."""

import os

import pytest
from pyspark.sql import functions as F

from textloom.sources import readers, sinks


def tree(path):
    return {os.path.relpath(os.path.join(d, f), path): open(os.path.join(d, f), "rb").read() for d, _, names in os.walk(path) for f in names}


def cases(spark, *rows):
    return spark.createDataFrame(list(rows), "corpus string, case_id string, text string")


def test_case_files_have_exact_names_and_texts(spark, tmp_path):
    path = str(tmp_path / "cases")
    sinks.write_cases(cases(spark, ("A", "7", "seven\n"), ("A", "1234", ""), ("B", "7", "a\r\nb"), ("B", "note x+1", "ü"), ("B", "8", None)), path)
    want = {"A/case_007.txt": b"seven\n", "A/case_1234.txt": b"", "B/case_007.txt": b"a\r\nb", "B/note x+1.txt": "ü".encode()}
    assert tree(path) == want
    got = {tuple(r) for r in readers.read_cases(spark, path).collect()}
    assert got == {("A", "case_007", "seven\n"), ("B", "case_007", "a\r\nb"), ("B", "note x+1", "ü")}


def test_case_files_delete_stale_twins_only(spark, tmp_path):
    path = str(tmp_path / "cases")
    sinks.write_cases(cases(spark, *[(c, str(k), f"{c}{k}") for c in "AB" for k in range(6)]), path)
    sinks.write_cases(cases(spark, ("A", "1", "new"), ("A", "3", "left out")), path, stale=spark.createDataFrame([("3",), ("5",), ("99",)], "case_id string"), overwrite=False)
    want = {f"{c}/case_{k:03d}.txt": f"{c}{k}".encode() for c in "AB" for k in range(6) if k not in (3, 5)} | {"A/case_001.txt": b"new"}
    assert tree(path) == want
    sinks.write_cases(cases(spark, ("C", "1", "only")), path)
    assert tree(path) == {"C/case_001.txt": b"only"}


@pytest.mark.parametrize("overwrite", [True, False])
def test_a_failed_write_leaves_the_folder_as_it_was(spark, tmp_path, overwrite):
    path = str(tmp_path / "cases")
    sinks.write_cases(cases(spark, ("A", "1", "one"), ("A", "2", "two")), path)
    before = tree(path)
    many = spark.range(50).select(F.lit("A").alias("corpus"), F.col("id").cast("string").alias("case_id"), F.when(F.col("id") < 49, "x").otherwise(F.raise_error(F.lit("broken"))).alias("text"))
    for bad in (many, cases(spark, ("A", "1", "x"), ("A", "../1", "x")), cases(spark, ("A", "1", "x"), ("A", "1", "y")), cases(spark, (None, "1", "x"))):
        with pytest.raises(Exception):  # noqa: B017
            sinks.write_cases(bad, path, overwrite=overwrite)
        assert tree(path) == before


def test_decoding(spark, tmp_path):
    folder = tmp_path / "A"
    folder.mkdir()
    texts = {"case_001.txt": "plain ü €".encode(), "case_002.txt": b"", "case_003.txt": b"a\xffb", "case_004.txt": b"cut \xe2\x82", "case_005.txt": b"\xed\xa0\x80 \xc0\xaf \xf5", "case_006.txt": "\ufffd own".encode(), "other.txt": b"\xff"}
    for name, raw in texts.items():
        (folder / name).write_bytes(raw)
    cases_ = {k[:-4]: v for k, v in texts.items() if k.startswith("case_") and v}
    lenient = {r.case_id: r.text for r in readers.corpus_folder(spark, str(folder), "A", errors="replace").collect()}
    assert lenient == {k: v.decode("utf-8", "replace") for k, v in cases_.items()}
    good = {k: v.decode() for k, v in cases_.items() if k not in ("case_003", "case_004", "case_005")}
    assert {r.case_id: r.text for r in readers.corpus_folder(spark, str(folder), "A", errors="skip").collect()} == good
    assert {(r.case_id, r.n_bytes) for r in readers.corpus_rejects(spark, str(folder), "A").collect()} == {(k, len(v)) for k, v in cases_.items() if k not in good}
    with pytest.raises(Exception, match="(?i)utf"):
        readers.corpus_folder(spark, str(folder), "A").collect()
    strict = readers.corpus_folder(spark, str(folder), "A", glob="case_00[126].txt").collect()
    assert {r.case_id: r.text for r in strict} == good


def lines(*rows):
    return "".join("\t".join(r) + "\r\n" for r in rows).encode()


@pytest.fixture
def release(tmp_path):
    """Two releases whose files order their columns in different ways, with files and rows that don't count."""
    a, b = tmp_path / "2023" / "Snapshot", tmp_path / "2024" / "Full"
    a.mkdir(parents=True)
    b.mkdir(parents=True)
    head = ("id", "active", "conceptId", "languageCode", "typeId", "term")
    fsn, synonym = "900000000000003001", "900000000000013009"
    rows = [(str(k), "01"[k % 3 > 0], f"C{k}", ["en", "en-GB", "es", " EN "][k % 4], [fsn, synonym, "1"][k % 3 % 2 + (k % 7 == 0)], f'name "{k}" ü') for k in range(500)]
    (a / "sct2_Description_Snapshot-en_X_2023.txt").write_bytes(lines(head, *rows) + b"1\t1\tshort\r\n\r\n9\t1\tC9\ten\t" + fsn.encode() + b"\tbro\xffken\textra\r\n")
    (b / "sct2_Description_Full-en_X_2024.txt").write_bytes(lines(("term", "typeId", "active", "conceptId", "languageCode"), ("full", fsn, "1", "F1", "en"), ("old", fsn, "0", "F2", "en")).rstrip())
    (b / "sct2_Description_Delta-en_X_2024.txt").write_bytes(lines(("term", "active"), ("no concept", "1")))
    (b / "sct2_TextDefinition_Full_X.txt").write_bytes(lines(head, rows[0]))
    (b / "sct2_Description_Delta-en_Y.txt").write_bytes(b"")
    want = [(r[2], r[5], 0 if r[4] == fsn else 1) for r in rows if r[1] == "1" and r[3].strip().lower().startswith("en") and r[4] != "1"] + [("C9", "bro\ufffdken", 0)]
    return str(tmp_path), want, len(rows)


@pytest.mark.parametrize("pushed", ["true", "false"])
def test_release_files(spark, release, pushed):
    root, want, _ = release
    spark.conf.set("spark.sql.python.filterPushdown.enabled", pushed)
    try:
        assert sorted(map(tuple, readers.rf2_descriptions(spark, root).collect())) == sorted(want)
        assert {r.concept for r in readers.rf2_descriptions(spark, root, "Full").collect()} == {"F1"}
        assert readers.rf2_descriptions(spark, root, "all").count() == len(want) + 1
        assert not readers.rf2_descriptions(spark, root, "Delta").collect() and not readers.rf2_isa(spark, root).collect()
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_release_ranges_of_any_size_hold_each_line_once(spark, release):
    root, _, n = release
    for size in (1_000, 4_099, 1 << 20):
        rows = readers.release_rows(spark, root, "description", "Snapshot", size)
        assert sorted(int(r.id) for r in rows.collect()) == sorted([*range(n), 9])


def test_release_filters_reach_the_files(release):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In
    from pyspark.sql.types import StringType, StructField, StructType

    from textloom.sources.release import PushingReader

    root, _, n = release
    reader = PushingReader(root, "description", 1 << 20, StructType([StructField(c, StringType()) for c in ("release", "conceptId", "moduleId")]))
    left = list(reader.pushFilters([EqualTo(("release",), "Snapshot"), EqualTo(("active",), "1"), In(("conceptId",), ("C1", "C2", "C3")), GreaterThan(("term",), "a")]))
    assert left == [GreaterThan(("term",), "a")]
    (part,) = reader.partitions()
    assert part.release == "Snapshot"
    assert [r for b in reader.read(part) for r in b.to_pylist()] == [{"release": "Snapshot", "conceptId": c, "moduleId": None} for c in ("C1", "C2")]
