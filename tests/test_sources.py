import pytest

from noteweave.operators import catalogue
from noteweave.sources import catalogs, documents


def test_delimited_json_fixed(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("﻿ICD_Code\tName\tBillable\nI10\tHigh pressure\t1\n", encoding="utf-8")
    (tmp_path / "c.json").write_text('{"records": [{"code": "I10", "description": "High", "synonyms": ["a", "b"]}]}')
    (tmp_path / "c.txt").write_text(f"{1:05d} I5021   1 {'short':<60} long\nx\n")
    for name in ("c.tsv", "c.json", "c.txt"):
        r = catalogs.read_catalog(spark, str(tmp_path / name)).collect()
        assert len(r) == 1 and r[0]["code"] in ("I10", "I5021")
    (tmp_path / "bad.csv").write_text("x,y\n1,2\n")
    with pytest.raises(catalogs.MissingColumns):
        catalogs.read_catalog(spark, str(tmp_path / "bad.csv"))
    catalogs.write_catalog(catalogs.read_catalog(spark, str(tmp_path / "c.json")), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).where("chapter = 'I'").count() == 1
    assert catalogue.merge_duplicates(catalogue.standard_rows(catalogs.read_catalog(spark, str(tmp_path / "c.json")))).first()["synonyms"] is not None


def test_documents(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("café".encode())
    (tmp_path / "b.txt").write_bytes("café".encode("latin-1"))
    (tmp_path / "c.bin").write_bytes(b"%PDF-1.4 ...")
    (tmp_path / "d.txt").write_bytes(b" \n ")
    got = {r["path"].rsplit("/", 1)[1]: (r["format"], r["text"], r["status"]) for r in documents.read_documents(spark, str(tmp_path)).collect()}
    assert got["a.txt"] == ("TEXT", "café", "READY") and got["b.txt"] == ("TEXT", "café", "READY")
    assert got["c.bin"][0] == "PDF" and got["c.bin"][2] == "NEEDS_OCR" and got["d.txt"][2] == "EMPTY"


def test_pages(spark):
    p = spark.createDataFrame([("d", 1, "abc", True), ("d", 2, None, True), ("d", 3, "x", True)], "document_id string, page_no int, text string, has_image boolean")
    assert [r["start_char"] for r in documents.page_starts(p).orderBy("page_no").collect()] == [0, 5, 7]
    assert documents.scan_status(p).first()["status"] == "NEEDS_OCR"


def test_lines(spark, tmp_path):
    (tmp_path / "s.csv").write_text("h\na\n\nb\n")
    assert [(r["line_no"], r["raw_line"]) for r in catalogs.read_lines(spark, str(tmp_path)).orderBy("line_no").collect()] == [(1, "h"), (2, "a"), (4, "b")]


def test_folder_of_catalogues(spark, tmp_path):
    """The first file by name wins, whatever its size; other files are left out."""
    (tmp_path / "b.csv").write_text("code,description\nI10,second\n" + "".join(f"A{k:02}.0,x\n" for k in range(50)))
    (tmp_path / "a.json").write_text('[{"code": "I10", "description": "first"}]')
    (tmp_path / "notes.md").write_text("code")
    rows = catalogs.read_catalog(spark, str(tmp_path))
    merged = {r["clean"]: r["description"] for r in catalogue.merge_duplicates(catalogue.standard_rows(rows)).collect()}
    assert merged["I10"] == "first" and len(merged) == 51
    (tmp_path / "empty").mkdir()
    assert catalogs.read_catalog(spark, str(tmp_path / "empty")).count() == 0
