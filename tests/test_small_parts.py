"""Versions in two orders, quick comparison, briefings, indices, documents by stem and as YAML."""

import json

import pytest

from marlstone.operators import versions
from marlstone.sources import ir, store


def test_versions_in_two_orders(spark):
    files = spark.createDataFrame([("a_RevB.pdf", "1", 3, "2020", "B"), ("a_RevA.pdf", "2", 3, "2021", "A"), ("a.pdf", "3", 3, None, ""), ("lone.pdf", "4", 1, None, None)], "filename string, sha256 string, pages int, date string, revision string")
    assert versions.families(files).first().versions == ["a.pdf", "a_RevB.pdf", "a_RevA.pdf"]
    assert versions.families(files, "revision").first().versions == ["a_RevA.pdf", "a_RevB.pdf", "a.pdf"]
    with pytest.raises(ValueError):
        versions.families(files, "size")


def test_quick_comparison_with_pages_and_revisions(spark):
    of = lambda rows: spark.createDataFrame(rows, "k int, filename string, text string, pages int")
    a, b = of([(1, "x_RevA.pdf", "Revision A of this", 3), (2, "p.pdf", None, 1)]), of([(1, "x_RevB.pdf", "Rev B", 4), (2, "q.pdf", "other", 1)])
    got = {r.k: tuple(r)[1:] for r in versions.quick_compare(a, b, "k").collect()}
    assert got == {1: (0.0, True, "A", "B", 3, 4, False), 2: (0.0, False, "", "", 1, 1, True)}


def test_briefing_of_named_documents(spark):
    docs = spark.createDataFrame([(1, "in/ICD_A.pdf", "Rev C, May 2020", 5), (2, "ICD_B.pdf", "", 1), (3, "other.pdf", "x", 1)], "doc int, filename string, text string, pages int")
    items = spark.createDataFrame([(1, "TBD", "i1"), (1, "TBR", "i2"), (1, "TBD", "i3"), (3, "TBD", "i4")], "doc int, item_type string, item_id string")
    rows, found = versions.gather(docs, items, ["ICD_A", "ICD_B", "gone"])
    assert sorted(tuple(r) for r in rows.collect()) == [(1, "ICD_A", "in/ICD_A.pdf", "C", "May 2020", 5, 2, 1), (2, "ICD_B", "ICD_B.pdf", "", "", 1, 0, 0)]
    assert sorted((r.item_id, r.stem) for r in found.collect()) == [("i1", "ICD_A"), ("i2", "ICD_A"), ("i3", "ICD_A")]
    named = spark.createDataFrame([("ICD_B",), ("gone",), ("ICD_B",)], "stem string")
    assert [r.doc for r in versions.gather(docs, items, named)[0].collect()] == [2]
    assert versions.summary(docs).agg({"tbd_count": "sum"}).first()[0] == 0


def test_indices_are_made_once_and_listed(spark, tmp_path):
    root = f"file://{tmp_path}/idx"
    assert store.list_indices(spark, root).count() == 0
    index = store.Index(spark, root, store.index_name("Para", "64"), 2)
    schema = "doc string, chunk int, embedding array<float>"
    assert not index.exists() and index.create(schema) and not index.create(schema) and index.exists()
    index.write(spark.createDataFrame([("a", 0, [1.0, 2.0]), ("a", 1, [1.0]), ("b", 0, [1.0, 2.0])], schema))
    (row,) = store.list_indices(spark, root).collect()
    assert (row[0], row.n_chunks, row.n_docs) == ("icd_para_64", 2, 2) and row.bytes > 0 and index.quarantined().count() == 1
    assert store.run_folder("out/", "2024-01-01T10", "A b/c.pdf") == "out/run=2024-01-01T10/doc=A_b_c.pdf"


def test_documents_by_stem_and_as_yaml(spark, tmp_path):
    doc = {"metadata": {"filename": "a.pdf", "sha256": "h"}, "pages": [{"page_number": 1, "text_blocks": [{"id": "b", "text_verbatim": "é: [x]\nline", "page": 1}]}]}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a_document_ir.json").write_text(json.dumps(doc))
    (tmp_path / "in" / "bad_document_ir.json").write_text('{"metadata": ')
    (tmp_path / "in" / "c_document_ir.json").write_text(json.dumps(doc))
    got = ir.read_stems(spark, f"file://{tmp_path}/in", ["a", "bad", "gone"])
    assert [r.stem for r in got.collect()] == ["a"]
    ir.write_yaml(got, f"file://{tmp_path}/yaml")
    back = ir.read_yaml(spark, f"file://{tmp_path}/yaml/*")
    assert back.select("metadata", "pages").collect() == got.select("metadata", "pages").collect()
