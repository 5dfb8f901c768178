"""Tables of contents, validation and page reports against plain loops."""

import random
import re

import pytest

from marlstone.operators import contents, requirements, versions


def plain_contents(spans):
    """The rule, span by span."""
    entries = []
    for x, y, text in spans:
        text = text.strip()
        if not text or y < 60 or y > 700 or "table of contents" in text.lower():
            continue
        if text.count(".") > 5:
            m = re.match(r"^(.+?)\.{3,}\s*([ivxlcdmIVXLCDM\d]+)?\s*$", text)
            title, ref = (m[1].strip(), m[2] or "") if m else (re.sub(r"\.{3,}.*$", "", text).strip(), "")
            if m or title:
                entries.append([title, ref, y, x - 90, False])
        elif re.match(r"^\d+$", text):
            if entries:
                entries[-1][1] = text
        elif re.match(r"^\d+\.", text):
            entries.append([text, "", y, x - 90, True])
        elif len(text) > 3:
            entries.append([text, "", y, x - 90, False])
    out, k = [], 0
    while k < len(entries):
        a = entries[k]
        if a[4] and k + 1 < len(entries):
            b = entries[k + 1]
            out.append((a[0] + " " + b[0], b[1] or a[1], a[2], a[3]))
            k += 2
        else:
            out.append(tuple(a[:4]))
            k += 1
    return out if sum(bool(e[1]) for e in out) >= 3 else []


def test_contents_equal_the_rule_with_chained_prefixes(spark):
    r = random.Random(9)
    texts = ["1.", "2.", "3.4", "3.4.1 ", "Scope ........ 3", "Purpose .......", "A....... b c", "......... 9", "12", "7", "Means ...... iv", "Other text", "abc", "", " Table of Contents", "Ends.........X"]
    pages = {(d, p): [(90.0 + r.randint(0, 3) * 9, float(r.choice([30, 60, 100, 400, 700, 701])) if r.random() < 0.3 else 100.0 + k, r.choice(texts)) for k in range(r.randint(0, 25))] for d in range(4) for p in range(25)}
    rows = [(d, p, k, *s) for (d, p), spans in pages.items() for k, s in enumerate(spans)]
    got = {}
    for x in contents.table_of_contents(spark.createDataFrame(r.sample(rows, len(rows)), "doc int, page int, ord int, x0 double, y0 double, text string")).collect():
        got.setdefault((x.doc, x.page), []).append((x.place, x.title, x.page_ref, x.y, x.indent))
    want = {k: [(n, *e) for n, e in enumerate(plain_contents(s))] for k, s in pages.items() if plain_contents(s)}
    assert {k: sorted(v) for k, v in got.items()} == want and len(want) > 20


def plain_issues(blocks):
    sections = {m[1].rstrip(".") for *_, t in blocks if (m := re.match(r"^(\d+[\.\d]*\.?)\s+\S", t.strip()))}
    tables = {m[1] for *_, t in blocks if t.strip().startswith("Table ") and (m := re.match(r"[Tt]able\s+([\d\.]+[-\d]*)", t.strip()))}
    out = []
    for page, _, block, t in blocks:
        for m in re.finditer(r"[Ss]ection\s+(\d+[\.\d]*)", t):
            if m[1].rstrip(".") not in sections:
                out.append(("warning", "cross_ref", f"Section {m[1].rstrip('.')} referenced but not found as a heading", page, block))
        for m in re.finditer(r"[Tt]able\s+([\d\.]+[-\d]*)", t):
            if not t.strip().startswith("Table ") and m[1] not in tables:
                out.append(("info", "cross_ref", f"Table {m[1]} referenced — verify it exists", page, block))
    plain = sorted((int(s) for s in sections if "." not in s))
    out += [("warning", "structure", f"Gap in section numbering: {a} → {b}", 0, "") for a, b in zip(plain, plain[1:]) if b - a > 1]
    return sorted(out, key=lambda i: ("error", "warning", "info").index(i[0]))


def test_validation_is_one_ordered_list(spark):
    r = random.Random(5)
    parts = ["see Section 3.2. and section 9", "Table 4-1 Limits", "table 4-1 or Table 5.", "2 Scope", "3.2 Power", "7. End", "11 More", "Section 2", "plain", "Sections 4", "Table 6: see Table 9", "section 8.1.2 and Section 8.1.3"]
    docs = {d: [(p, o, f"b{p}-{o}", r.choice(parts)) for p in range(1, 4) for o in range(r.randint(0, 6))] for d in range(12)}
    rows = [(d, *b) for d, bs in docs.items() for b in bs]
    got = {}
    for x in requirements.validate(spark.createDataFrame(r.sample(rows, len(rows)), "doc int, page int, ord int, block_id string, text string")).orderBy("doc", "place").collect():
        got.setdefault(x.doc, []).append((x.severity, x.category, x.message, x.page, x.block_id))
    assert got == {d: plain_issues(b) for d, b in docs.items() if plain_issues(b)}


def test_page_reports_and_totals(spark):
    of = lambda d: spark.createDataFrame(d, "doc string, page int, text string")
    a = of([("d", 1, "a b  c"), ("d", 2, "x y x"), ("d", 3, "p q"), ("d", 4, "only here"), ("e", 1, ""), ("f", 1, "one two three")])
    b = of([("d", 1, "a b c"), ("d", 2, "y x"), ("d", 3, "p r s"), ("e", 1, ""), ("f", 1, "four"), ("f", 2, "new")])
    pages = versions.page_report(a, b, "doc")
    assert sorted(tuple(r) for r in pages.collect()) == [
        ("d", 1, 3, [], [], "exact"), ("d", 2, 2, [], [], "whitespace"), ("d", 3, 2, ["q"], ["r", "s"], "differs"), ("e", 1, 0, [], [], "exact"), ("f", 1, 3, ["one", "three", "two"], ["four"], "differs"),
    ]
    totals = versions.text_totals(pages, "doc")
    assert sorted(tuple(r) for r in totals.collect()) == [
        ("d", 3, 1, 1, 1, 7, 1, 2, pytest.approx(600 / 7, abs=1e-5), pytest.approx(250 / 3, abs=1e-5), 1, 3), ("e", 1, 1, 0, 0, 0, 0, 0, 100.0, 100.0, 1, 1), ("f", 1, 0, 0, 1, 3, 3, 1, 0.0, 0.0, 1, 1),
    ]
    report = {r.doc: r.report for r in versions.text_report(pages, totals, "doc", names=2).collect()}
    assert "| 3 | Differs | 2 | 1 | 2 | Missing: q; Extra: r, s |" in report["d"] and "| Word retention | 85.7% |" in report["d"] and "Missing: one, three; Extra: four |" in report["f"]


def test_revision_totals(spark):
    a = spark.createDataFrame([("d", "1 A", 1, 1, "x y z"), ("d", "2 B", 2, 1, "same words")], "doc string, heading string, ord int, page int, text string")
    b = spark.createDataFrame([("d", "1 A", 1, 1, "x y shall"), ("d", "2 B", 2, 1, "same words"), ("d", "3 C", 3, 1, "new TBD")], "doc string, heading string, ord int, page int, text string")
    got = versions.revision_totals(versions.compare_sections(a, b, "doc"), "doc").first()
    assert (got.added, got.removed, got.modified, got.unchanged, got.requirement_changes, got.tbd_changes, got.technical, got.old_words, got.new_words, got.word_similarity) == (1, 0, 1, 1, 1, 1, 1, 5, 7, 0.5)


def test_boilerplate_is_counted_by_occurrence_and_empty_sections_are_unchanged(spark):
    rows = [
        ("d", "1", "modified", "technical", True, ["Rev A → Rev B"], None, None), ("d", "2", "modified", "structural", True, ["Rev A → Rev B", "Rev A → Rev B", "real → change"], 0, 0), ("d", "3", "modified", "technical", True, ["Rev A → Rev B"], 1, 0),
        ("d", "4", "modified", "technical", True, ["Rev A → Rev B"], 0, 2), ("d", "5", "modified", "technical", True, [], 0, 0), ("d", "6", "added", "structural", False, ["Rev A → Rev B"], 0, 0), ("d", "7", "modified", "technical", True, ["+ x → y", "+ x → y", "+ x → y"], 0, 0),
        ("e", "1", "modified", "technical", True, ["Rev A → Rev B", "Rev A → Rev B"], 0, 0), ("e", "2", "modified", "technical", True, None, 0, 0),
    ]
    schema = "doc string, heading string, change_type string, classification string, has_requirement_change boolean, snippets array<string>, value_changes int, tbd_changes int"
    out, stamps = versions.without_boilerplate(spark.createDataFrame(rows, schema), "doc")
    got = {(r.doc, r.heading): (r.change_type, r.classification, r.has_requirement_change, r.snippets) for r in out.collect()}
    assert [tuple(r) for r in stamps.collect()] == [("d", "Rev A → Rev B", 5)]
    assert got["d", "1"] == ("unchanged", "editorial", False, []) and got["d", "2"] == ("modified", "structural", True, ["real → change"])
    assert got["d", "3"] == got["d", "4"] == ("modified", "technical", True, []) and got["d", "5"] == ("modified", "technical", True, [])
    assert got["d", "6"][3] == ["Rev A → Rev B"] and len(got["d", "7"][3]) == 3 and len(got["e", "1"][3]) == 2 and got["e", "2"][3] is None and len(got) == 9
