"""Hand-computed cases for page contents, block splitting, hidden text, OCR answers, undo and reports."""

import json

from marlstone.operators import pagework


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_D22_page_content(spark):
    spans = [(1, 1, 0, "Left head", 10.0, 20.0, 10.0), (1, 1, 1, "Page 3", 500.0, 750.0, 10.0), (1, 1, 2, "Intro....... 3", 50.0, 100.0, 10.0), (1, 1, 3, "Scope...... 4", 50.0, 120.0, 10.0), (1, 1, 4, "3.1 Power...... 7", 50.0, 140.0, 10.0),
             (1, 2, 0, "Big title", 50.0, 300.0, 20.0), (1, 2, 1, "  ", 50.0, 320.0, 10.0), (1, 3, 0, "head", 250.0, 10.0, 9.0), (1, 3, 1, "• one", 50.0, 100.0, 10.0), (1, 3, 2, "- two", 50.0, 600.0, 10.0)]
    s = spark.createDataFrame(spans, "doc int, page int, ord int, text string, x0 double, y0 double, size double")
    p = spark.createDataFrame([(1, i, 612.0, 792.0, d) for i, d in ((1, 0), (2, 0), (3, 0), (4, 30), (5, 0))], "doc int, page int, width double, height double, drawings int")
    got = {r.page: r for r in pagework.page_content(s, p, "doc", "page").collect()}
    assert [got[i].page_type for i in range(1, 6)] == ["table_of_contents", "title_page", "list", "table", "text"]
    assert (got[1].header_left, got[1].footer_right, got[3].header_center, got[2].header_left) == ("Left head", "Page 3", "head", None)
    assert (got[2].titles, got[2].paragraphs, got[3].list_items, got[3].paragraphs) == (["Big title"], 0, ["• one", "- two"], 1)
    assert (got[4].table_grid_elements, got[4].table_y_min, got[4].table_y_max, got[1].table_y_max) == (30, 0.0, 20.0, 0.0)


def test_W14_split_by_style(spark):
    def parts(*lines):
        df = spark.createDataFrame([(1, i, *line) for i, line in enumerate(lines)], "b int, line int, text string, size double, bold boolean")
        return [r.part for r in pagework.split_by_style(df, "b").orderBy("line").collect()]

    assert parts(("text", 10.0, False)) == [0]
    assert parts(("text", 10.0, False), ("3.1 Power", 10.0, False), ("3.2 Thermal", 10.0, False), ("body", 10.0, False)) == [0, 1, 1, 1]
    assert parts(("body", 10.0, False), ("Title", 12.0, False), ("body", 10.0, False)) == [0, 1, 1]  # 12 points are no heading that ends
    assert parts(("Title", 14.0, False), ("body", 10.0, False)) == [0, 1]
    assert parts(*[("Title", 14.0, False)] * 4, ("body", 10.0, False)) == [0] * 5  # after more than three lines a drop is none
    assert parts(("a", 10.0, False), ("B", 10.0, True)) == [0, 0] and parts(("a", 10.0, False), ("b", 10.0, False), ("C", 10.0, True)) == [0, 0, 1]
    assert parts(("1.1 A.... 1", 10.0, False), ("1.2 B.... 2", 14.0, False), ("end", 10.0, True)) == [0, 0, 0]


def test_W11_lines_drift_from_the_first_span(spark):
    s = [("a", 100.0, 1.0, 10.0), ("b", 103.0, 5.0, 10.0), ("c", 104.0, 0.0, 10.0), ("d", 125.0, 0.0, 10.0), ("3.1 x", 130.0, 0.0, 10.0), ("e", 140.0, 0.0, 10.0), ("H", 150.0, 0.0, 14.0), ("f", 160.0, 0.0, 10.0)]
    df = spark.createDataFrame([(1, i, *x) for i, x in enumerate(s)], "page int, ord int, text string, y0 double, x0 double, size double")
    assert rows(pagework.paragraphs(df, "page"), "paragraph", "text") == [(0, "a b\nc"), (1, "d"), (2, "3.1 x\ne"), (3, "H"), (4, "f")]


def test_G14_heading_lines(spark):
    def parts(*lines):
        df = spark.createDataFrame([(1, i, *line) for i, line in enumerate(lines)], "b int, line int, text string, font string, flags int")
        return [p for _, p in rows(pagework.split_heading(df, "b"), "line", "part")]

    assert parts(("4. Power", "Arial", 0), ("text", "TimesNewRoman", 0), ("more", "Arial", 0)) == ["heading", "paragraph", "paragraph"]
    assert parts(("a", "Arial", 0), ("b", "Arial", 0)) == ["paragraph"] * 2 and parts(("a", "X-Bold", 0), ("b", "X", 16)) == ["heading"] * 2


def test_G7_G8_G9_page_split(spark):
    def block(page, n, y0, y1, kind="paragraph"):
        return 1, page, n, f"block-p{page:02d}-b{n:02d}", kind, y0, y1

    b = spark.createDataFrame([block(1, 0, 20.0, 40.0), block(1, 1, 100.0, 700.0), block(1, 2, 710.0, 730.0), block(1, 3, 800.0, 830.0), block(1, 4, 750.0, 760.0), block(1, 5, 700.0, 741.0, "table"), block(2, 0, 100.0, 200.0), block(3, 0, 100.0, 725.0)], "doc int, page int, ord int, block_id string, block_type string, y0 double, y1 double")
    got = rows(pagework.split_pages(b), "page", "block_id", "y0", "y1", "moved")
    assert got == [
        (1, "block-p01-b00", 20.0, 40.0, False), (1, "block-p01-b01", 100.0, 700.0, False), (1, "block-p01-b04", 750.0, 760.0, False), (1, "block-p01-b05", 700.0, 741.0, False),
        (2, "block-p02-b00", 72.0, 92.0, True), (2, "block-p02-b01", 98.0, 128.0, True), (3, "block-p03-b00", 100.0, 200.0, False), (5, "block-p05-b00", 72.0, 697.0, True),
    ]
    assert rows(pagework.page_overflow(b), "page", "overflow") == [(1, 10.0), (2, 0.0), (3, 5.0)]
    assert pagework.split_pages(b.where("page = 2")).first().block_id == "block-p02-b00"
    one = b.where("page = 2").union(spark.createDataFrame([block(2, 1, 210.0, 300.0)], b.schema))
    grown = spark.createDataFrame([("block-p02-b00", 600.0)], "block_id string, new_height double")
    assert rows(pagework.reflow_and_split(one, grown), "page", "y0", "y1", "moved") == [(2, 100.0, 700.0, False), (3, 72.0, 162.0, True)]


def test_J12_rogue_text(spark):
    box = "x0 double, y0 double, x1 double, y1 double"
    white, black = 0xFFFFFF, 0
    s = spark.createDataFrame([(1, 1, i, *x) for i, x in enumerate([
        (" near ", white, 105.0, 105.0, 140.0, 115.0), ("near", white, 106.0, 105.0, 140.0, 115.0), ("inside", white, 400.0, 400.0, 440.0, 410.0), ("nowhere", white, 400.0, 500.0, 440.0, 510.0),
        ("dark", black, 105.0, 105.0, 140.0, 115.0), ("shown", white, 300.0, 300.0, 340.0, 310.0), ("x", white, 105.0, 105.0, 140.0, 115.0), ("L" * 90, white, 105.0, 105.0, 140.0, 115.0), ("L" * 90, white, 106.0, 105.0, 140.0, 115.0),
    ])], f"doc int, page int, ord int, text string, color int, {box}")
    fill = spark.createDataFrame([(1, 1, 290.0, 290.0, 400.0, 320.0)], f"doc int, page int, {box}")
    blocks = spark.createDataFrame([(1, 1, 0, "b0", "it stands inside, near", 0.0, 0.0), (1, 1, 1, "b1", "other", 100.0, 100.0)], "doc int, page int, ord int, block_id string, text string, x0 double, y0 double")
    assert rows(pagework.rogue_text(s, fill, blocks), "ord", "block_id", "text") == [(0, "b1", "near"), (2, "b0", "inside"), (7, "b1", "L" * 80), (8, "b1", "L" * 80)]


def test_S11_S12_answers(spark):
    box = lambda x, y: {"BoundingBox": {"Left": x, "Top": y, "Width": 0.1, "Height": 0.05}}
    child = lambda *ids: [{"Type": "CHILD", "Ids": list(ids)}]
    blocks = [
        {"Id": "l", "BlockType": "LINE", "Confidence": 99.0, "Geometry": box(0, 0), "Relationships": child("w2", "w1")}, {"Id": "e", "BlockType": "LINE"},
        {"Id": "w1", "BlockType": "WORD", "Text": "one", "Confidence": 90.0, "Geometry": box(0.5, 0.1)}, {"Id": "w2", "BlockType": "WORD", "Text": "two"},
        {"Id": "c0", "BlockType": "CELL", "RowIndex": 9, "ColumnIndex": 9}, {"Id": "t", "BlockType": "TABLE", "Relationships": child("c0", "c1", "c2")},
        {"Id": "c1", "BlockType": "CELL", "RowIndex": 1, "ColumnIndex": 1, "Relationships": child("w1", "l", "w2")}, {"Id": "c2", "BlockType": "CELL", "RowIndex": 2, "ColumnIndex": 1, "ColumnSpan": 2, "Text": "own"},
    ]
    a = spark.createDataFrame([(1, 1, 200.0, 100.0, json.dumps({"Blocks": blocks})), (1, 2, 200.0, 100.0, "{}")], "doc int, page int, width double, height double, answer string")
    assert rows(pagework.document_words(a), "text", "x0", "y0", "x1", "y1", "confidence") == [("one", 100.0, 10.0, 120.0, 15.0, 90.0), ("two", 0.0, 0.0, 0.0, 0.0, 0.0)]
    assert rows(pagework.document_lines(a), "line", "text", "words") == [(0, "two one", 2), (1, "", 0)]
    assert rows(pagework.document_cells(a), "row", "col", "col_span", "text", "rows", "cols") == [(1, 1, 1, "one two", 2, 1), (2, 1, 2, "own", 2, 1)]
    found = [{"Type": "LINE", "DetectedText": "no"}, {"Type": "WORD", "DetectedText": "yes", "Confidence": 80.0, "Geometry": box(0.1, 0.2)}]
    d = spark.createDataFrame([(1, 1, 200.0, 100.0, json.dumps({"TextDetections": found}))], a.schema)
    assert rows(pagework.detected_words(d), "text", "x0", "y0", "confidence") == [("yes", 20.0, 20.0, 80.0)]


def test_T3_undo_and_redo(spark):
    b = spark.createDataFrame([("a", "the new text"), ("b", "something"), ("c", "kept")], "block_id string, text string")
    a = spark.createDataFrame([("a", "old", "new"), ("b", "before", "absent")], "block_id string, old_text string, new_text string")
    undone = pagework.apply_undo(b, a)
    assert rows(undone, "block_id", "text") == [("a", "the old text"), ("b", "before"), ("c", "kept")]
    assert rows(pagework.apply_undo(undone, a, redo=True), "block_id", "text") == [("a", "the new text"), ("b", "absent"), ("c", "kept")]


def test_R1_change_report(spark):
    schema = "page int, block_id string, change_type string, old_text string, new_text string"
    c = spark.createDataFrame([(2, "x", "modified", "a\nb", "c"), (1, "y", "added", None, "new" * 30)], schema)
    text = [t for *_, t in sorted(((r.section, r.page or 0, r.block_id or "", r.line, r.text) for r in pagework.change_report(c).collect()))]
    assert text == ["# Change Report (2 changes)", "", "| Type | Count |", "|------|-------|", "| Modified | 1 |", "| Added | 1 |", "| Removed | 0 |", "", "## Modified Blocks", "", "**Page 2** (x)", "- Old: `a b`", "- New: `c`", "", "## Added Blocks", "", f"- Page 1: `{('new' * 30)[:50]}`"]
    assert [r.text for r in pagework.change_report(c.where("false")).orderBy("line").collect()] == ["# Change Report", "", "No changes detected."]
