"""Records of several shapes, differing fragments, terms in texts."""

import json
import random
import re

from pyspark.sql import functions as F

from marlstone.operators import fragments, versions
from marlstone.sources import shapes


def variants(spark, values):
    rows = spark.createDataFrame([(i, json.dumps(v) if not isinstance(v, str) else v) for i, v in enumerate(values)], "id int, text string")
    return shapes.parse(rows)


def test_broken_records_are_kept_apart(spark):
    rows = spark.createDataFrame([(1, '{"a": 1}'), (2, '{"a": '), (3, None), (4, "[1]"), (5, ""), (6, "3")], "id int, text string")
    good, bad = shapes.parse(rows)
    assert [r.id for r in good.collect()] == [1] and sorted(r.id for r in bad.collect()) == [2, 3, 4, 5, 6] and bad.columns == rows.columns


def test_pages_of_two_forms(spark):
    real = {"page_number": 3, "text_blocks": [
        {"block_type": "heading", "text_verbatim": " 3.2 Scope\n", "bbox": {"y0": 5}}, {"block_type": "heading", "text_verbatim": "Notes", "bbox": None}, {"text_verbatim": "  \t "}, {"text_verbatim": None, "text": "hidden"},
        {"text": "only text", "text_verbatim": "x"}, {"text_verbatim": "plain"}], "tables": [{"bbox": {"y0": 7.5}, "rows": [1, 2]}, {"cells": []}]}
    plain = {"headings": [{"text": "A", "y": 1, "section_number": "1"}], "text_blocks": [{"text": " kept ", "y": 2}], "tables": [{"y": 9}]}
    bare = {"text_blocks": [{"text": " "}, {"text": "b", "y": 4}]}
    empty = {"page_number": None}
    good, _ = variants(spark, [real, plain, bare, empty])
    got = [r.p for r in good.select("id", shapes.normalized_page(F.col("v")).alias("p")).orderBy("id").collect()]
    assert [tuple(h) for h in got[0].headings] == [("3.2 Scope", 5.0, "3.2"), ("Notes", 0.0, None)] and [tuple(t) for t in got[0].text_blocks] == [("x", 0.0), ("plain", 0.0)]
    assert [tuple(t) for t in got[0].tables] == [(7.5, "[1,2]", None), (0.0, None, "[]")] and got[0].page_number == 3
    assert [tuple(h) for h in got[1].headings] == [("A", 1.0, "1")] and [tuple(t) for t in got[1].text_blocks] == [(" kept ", 2.0)] and got[1].tables[0].y == 9.0 and got[1].page_number == 0
    assert [tuple(t) for t in got[2].text_blocks] == [(" ", 0.0), ("b", 4.0)] and got[2].headings == []
    assert (got[3].page_number, got[3].headings, got[3].text_blocks, got[3].tables) == (None, [], [], [])
    assert [tuple(r) for r in shapes.elements(good.where("id = 1"), "v", "id").orderBy("kind").collect()] == [(1, 0, "heading", 0, 1.0, "A", "1"), (1, 0, "text", 0, 2.0, " kept ", None)]


def test_vectors_of_all_shapes(spark):
    answers = [
        {"embedding": [1, 2.5]}, {"embeddings": [[1, 2.5], [3]]}, {"embeddings": [1, 2.5]}, {"embeddings": {"float": [[1, 2.5]]}}, {"embeddings": {"uint8": [[1, 2.5]]}}, {"vector": [1, 2.5]}, {"data": [1, 2.5]}, {"output": [1, 2.5]},
        {"embedding": [], "output": [1, 2.5]}, {"embedding": ["a"], "data": [1, 2.5]}, {"embedding": ["a"]}, {"embeddings": {"other": [[1]]}}, {}, {"embedding": None},
    ]
    good, _ = variants(spark, answers)
    got = {r.id: r.x for r in good.select("id", shapes.vector(F.col("v")).alias("x")).collect()}
    assert all(got[i] == [1.0, 2.5] for i in range(10)) and [got[i] for i in range(10, 14)] == [None] * 4


def test_search_answers_with_missing_fields(spark):
    full = {"took": 4, "hits": {"total": {"value": 9}, "hits": [{"_id": "x", "_score": 1.5, "_source": {"chunk_id": "c", "text": "t", "document_hash": "h", "document_title": "d", "page_number": 2, "section_heading": "s", "content_type": "table", "metadata": {"a": 1}}}, {"_id": "y", "_score": None, "_source": {"text": None}}, {}]}}
    good, _ = variants(spark, [full, {}, {"hits": {}}])
    assert [tuple(r.t) for r in good.select("id", shapes.search_totals(F.col("v")).alias("t")).orderBy("id").collect()] == [(4, 9), (0, 0), (0, 0)]
    got = [tuple(r) for r in shapes.search_hits(good, "v", "id").orderBy("id", "rank").collect()]
    assert got == [
        (0, 1, "c", "t", 1.5, "h", "d", 2, "s", None, "table", '{"a":1}'), (0, 2, "y", None, None, "", "", 0, None, None, "paragraph", "{}"), (0, 3, "", "", 0.0, "", "", 0, None, None, "paragraph", "{}"),
    ]


def plain_fragment(old, new):
    """The rule, character by character."""
    p = 0
    while p < min(len(old), len(new)) and old[p] == new[p]:
        p += 1
    s = 0
    while s < min(len(old), len(new)) - p and old[-1 - s] == new[-1 - s]:
        s += 1
    begin, end = p, len(old) - s
    while begin and old[begin - 1] not in " \n":
        begin -= 1
    while end < len(old) and old[end] not in " \n":
        end += 1
    a = old[begin:end]
    b = old[begin:p] + new[p : len(new) - s] + old[len(old) - s : end]
    return (a, b) if old != new and a and a != b else None


def test_fragments_equal_the_rule(spark):
    r = random.Random(8)
    pick = lambda n: "".join(r.choice("ab \n😀") for _ in range(r.randint(0, n)))
    pairs = [(x := pick(25), r.choice([x, x[: len(x) // 2] + pick(3) + x[len(x) // 2 :], pick(20), x[:3] + x[6:], x + pick(4)])) for _ in range(600)]
    pairs += [("", "a"), ("a", ""), ("", ""), ("word " * 3000, "word " * 2999 + "wort ")]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)] + [(-1, None, "x")], "id int, a string, b string")
    got = {x.id: (x.old_fragment, x.new_fragment) for x in fragments.fragments(rows, "a", "b").collect()}
    want = {i: f for i, (a, b) in enumerate(pairs) if (f := plain_fragment(a, b))}
    assert got == want and len(want) > 300


def test_edited_pages(spark):
    of = lambda d: spark.createDataFrame(d, "page int, text string")
    got = fragments.edited_pages(of([(1, "a  b"), (2, "c"), (3, "x")]), of([(1, " a\nb"), (2, "d"), (4, "x")]))
    assert [r.page for r in got.collect()] == [2]


def test_terms_in_texts_wherever_they_begin(spark):
    r = random.Random(3)
    texts = [(i, "".join(r.choice("abAB-") for _ in range(r.randint(0, 40)))) for i in range(300)] + [(300, None), (301, "")]
    terms = [(k, "".join(r.choice("abA-") for _ in range(r.randint(1, 5)))) for k in range(80)] + [(80, None), (81, "")]
    t, w = spark.createDataFrame(texts, "text_id int, text string"), spark.createDataFrame(terms, "term_id int, term string")
    got = [tuple(x) for x in versions.contained(t, w, block=9, slot=40).collect()]
    want = {(i, k) for i, x in texts for k, y in terms if x and y and y.lower() in x.lower()}
    assert set(got) == want and len(got) == len(want) and versions.contained(t.limit(0), w).count() == versions.contained(t, w.limit(0)).count() == 0


def test_references_in_sections_and_on_other_pages(spark):
    pages = spark.createDataFrame([("a", 1, "see preNAS-7x"), ("a", 2, "nas-7 and NAS 7"), ("a", 3, "NAS-9"), ("b", 1, "nas-7"), ("c", 1, "none")], "doc string, page int, text string")
    terms = spark.createDataFrame([("b", 1, "NAS 7"), ("b", 0, "NAS-7"), ("z", 0, "NAS-9"), ("z", 1, " x ")], "target string, ord int, term string")
    sections = spark.createDataFrame([("a", 2, "NAS 7")], "doc string, page int, text string")
    got = sorted(tuple(x) for x in versions.cross_references(pages, terms, sections).collect())
    assert got == [("a", 1, "b", "NAS-7", "inline_mention"), ("a", 2, "b", "NAS 7", "applicable_document"), ("a", 3, "z", "NAS-9", "inline_mention")]


def test_counts_by_title(spark):
    stems = spark.createDataFrame([("ICD_Valve_2", ), ("Pump", ), ("", )], "stem string")
    items = spark.createDataFrame([("The icd_valve_ draft", "TBD"), ("the ICD_VALVE_ draft", "TBD"), ("valve", "TBR"), ("pump house", "TBD"), ("", "TBD"), (None, "TBD")], "title string, item_type string")
    got = sorted(tuple(x) for x in versions.title_counts(stems, items).collect())
    assert got == [("ICD_Valve_2", "TBD", 2), ("ICD_Valve_2", "TBR", 1), ("Pump", "TBD", 1)]


def test_titles_and_stems_meet_by_their_beginnings(spark, monkeypatch):
    """Texts are not sent to all blocks of terms, and short and long names find each other as in a loop."""
    r = random.Random(5)
    word = lambda most: "".join(r.choice("abA") for _ in range(r.randint(0, most)))
    stems, items = [word(24) for _ in range(60)], [(word(16), r.choice(["TBD", "TBR"])) for _ in range(300)] + [(None, "TBD")]
    monkeypatch.setattr(versions, "contained", None)
    got = {(x.stem, x.item_type): x.n for x in versions.title_counts(spark.createDataFrame([(s,) for s in stems], "stem string"), spark.createDataFrame(items, "title string, item_type string")).collect()}
    want = {}
    for s in set(stems) - {""}:
        for t, kind in items:
            if t and (s.lower()[:10] in t.lower() or t.lower() in s.lower()):
                want[s, kind] = want.get((s, kind), 0) + 1
    assert got == want and len(want) > 60


def test_titles_and_stems_do_not_go_through_the_driver(spark, monkeypatch):
    """Small files broadcast neither names nor titles nor the many keys of either, only the filter of bounded size; keys that collide in it change nothing."""
    r = random.Random(6)
    word = lambda most: "".join(r.choice("abA") for _ in range(r.randint(0, most)))
    stems, items = [word(24) for _ in range(60)], [(word(16), r.choice(["TBD", "TBR", None])) for _ in range(300)]
    want = {}
    for s in set(stems) - {""}:
        for t, kind in items:
            if t and (s.lower()[:10] in t.lower() or t.lower() in s.lower()):
                want[s, kind] = want.get((s, kind), 0) + 1
    for bits in (6, 24):
        monkeypatch.setattr(versions, "KEY_BITS", bits, raising=False)
        df = versions.title_counts(spark.createDataFrame([(s,) for s in stems], "stem string"), spark.createDataFrame(items, "title string, item_type string"))
        assert {(x.stem, x.item_type): x.n for x in df.collect()} == want and len(want) > 60
        joins = re.findall(r"BroadcastHashJoin[^\n]*", df._jdf.queryExecution().executedPlan().toString())
        assert joins and all("_word" in x for x in joins), joins
