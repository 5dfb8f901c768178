"""Versions of documents: families, block and section diffs, change classes, values, maturity, references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.store import scratch


def families(files: DataFrame, order: str = "date") -> DataFrame:
    """Groups of two or more files (filename, sha256, pages, date, revision) with one normalised stem.

    Versions go by date and revision, missing ones first, or with ``order="revision"`` by revision, a missing one as Z, and date.
    """
    if order not in ("date", "revision"):
        raise ValueError(f"no order {order}; there are date and revision")
    known = lambda c, v: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(v))
    by = [known("date", ""), known("revision", "")] if order == "date" else [known("revision", "Z"), known("date", "")]
    rows = files.withColumn("family", T.normalized_stem("filename"))
    g = rows.groupBy("family").agg(
        F.count("*").alias("n_versions"), F.count_distinct("sha256").alias("n_contents"), F.count_distinct("pages").alias("n_page_counts"),
        F.transform(F.array_sort(F.collect_list(F.struct(by[0].alias("a"), by[1].alias("b"), "filename"))), lambda x: x["filename"]).alias("versions"),
    ).where("n_versions >= 2")
    status = F.when(F.col("n_contents") == 1, "identical").when(F.col("n_page_counts") > 1, "page_count_differs").otherwise("content_differs")
    return g.withColumn("status", status)


def block_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(block_id, change, old_text, new_text) of blocks (block_id, text) that differ; equal ones are left out."""
    x = a.select("block_id", F.col("text").alias("old_text"), F.lit(True).alias("_a"))
    y = b.select("block_id", F.col("text").alias("new_text"), F.lit(True).alias("_b"))
    rows = x.join(y, "block_id", "full_outer")
    change = F.when(F.col("_b").isNull(), "removed").when(F.col("_a").isNull(), "added").otherwise("modified")
    return rows.withColumn("change", change).where((F.col("change") != "modified") | ~F.col("old_text").eqNullSafe(F.col("new_text"))).select("block_id", "change", "old_text", "new_text")


def _last(sections: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key and heading: of repeated headings the last in order."""
    rows = sections.withColumn("heading_key", F.lower(F.trim("heading")))
    return rows.groupBy(*keys, "heading_key").agg(F.max_by(F.struct("heading", "page", "text"), "ord").alias("s"))


def spec_set(text: Column) -> Column:
    pairs = F.zip_with(T.found(text, T.CHANGE_PATTERN, 1), T.found(text, T.CHANGE_PATTERN, 2), lambda v, u: F.concat(v, F.lit(" "), u))
    return F.array_sort(F.array_distinct(pairs))


def requirement_change(old: Column, new: Column) -> Column:
    p = F.lit(r"(?i)(?U)\b(shall|must)\b")
    return F.regexp_count(old, p) != F.regexp_count(new, p)


def tbd_change(old: Column, new: Column) -> Column:
    p = F.lit(r"(?i)(?U)\bTB[DR]\b")
    return F.regexp_count(old, p) != F.regexp_count(new, p)


def change_class(old: Column, new: Column) -> Column:
    """technical if requirement counts or specification values differ, structural if few words are shared, else editorial."""
    a, b = F.array_distinct(T.words(F.lower(old))), F.array_distinct(T.words(F.lower(new)))
    few = (F.size(a) > 0) & (F.size(b) > 0) & (T.jaccard(a, b) < 0.7)
    return F.when(requirement_change(old, new) | (spec_set(old) != spec_set(new)), "technical").when(few, "structural").otherwise("editorial")


def compare_sections(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """Sections (keys, heading, ord, page, text) of two versions matched by heading: change type, class and flags; unchanged ones stay."""
    k = list(keys)
    x, y = _last(a, k).withColumnRenamed("s", "old"), _last(b, k).withColumnRenamed("s", "new")
    rows = x.join(y, [*k, "heading_key"], "full_outer")
    old, new = F.trim("old.text"), F.trim("new.text")
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(old == new, "unchanged").otherwise("modified")
    both = F.col("change_type") == "modified"
    return rows.withColumn("change_type", kind).select(
        *k, F.coalesce("new.heading", "old.heading").alias("heading"), F.col("old.page").alias("page_old"), F.col("new.page").alias("page_new"), "change_type",
        F.when(both, change_class(old, new)).when(F.col("change_type") == "unchanged", "editorial").otherwise("structural").alias("classification"),
        F.when(both, requirement_change(old, new)).otherwise(False).alias("has_requirement_change"),
        F.when(both, tbd_change(old, new)).when(F.col("change_type") == "added", F.contains(F.lower("new.text"), F.lit("tbd"))).otherwise(False).alias("has_tbd_change"),
        F.substring(old, 1, 500).alias("old_text"), F.substring(new, 1, 500).alias("new_text"),
    )


def section_diff(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    return compare_sections(a, b, *keys).where("change_type <> 'unchanged'")


def diff_totals(compared: DataFrame, *keys: str) -> DataFrame:
    n = lambda v: F.count_if(F.col("change_type") == v).alias(v)
    return compared.groupBy(*keys).agg(n("added"), n("removed"), n("modified"), n("unchanged"), F.count_if("has_requirement_change").alias("requirement_changes"), F.count_if(F.col("classification") == "technical").alias("technical"))


def tbd_delta(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """Open items (keys, item_id) of two versions: resolved, introduced or unchanged."""
    k = [*keys, "item_id"]
    x, y = a.select(*k).distinct(), b.select(*k).distinct()
    parts = [(x.join(y, k, "left_anti"), "resolved"), (y.join(x, k, "left_anti"), "introduced"), (y.join(x, k, "left_semi"), "unchanged")]
    out = [d.withColumn("delta", F.lit(n)) for d, n in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


def boilerplate(snippets: DataFrame, least: int = 3) -> DataFrame:
    """Substitutions (section, snippet) that occur ``least`` times: stamps and running heads, not content."""
    return snippets.where(F.contains("snippet", F.lit("→")) & ~F.col("snippet").rlike("^[+-]")).groupBy("snippet").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def without_boilerplate(sections: DataFrame, *keys: str, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """Sections of comparisons (keys, heading, change_type, classification, has_requirement_change, snippets, value_changes, tbd_changes) without boilerplate, and that boilerplate as (keys, snippet, n).

    Boilerplate are substitutions that occur ``least`` times in the modified sections of one comparison, however many sections that are; what is added or removed is content even if it repeats. A
    modified section of which no snippet is left, and which has no changed value or open item, is unchanged and editorial. Sections that had no snippets stay as they are. Headings are unique in a comparison;
    value_changes and tbd_changes are counts, null for none.
    """
    k, of = list(keys), [*keys, "heading"]
    said = sections.where((F.col("change_type") == "modified") & (F.size("snippets") > 0)).select(*of, F.posexplode("snippets").alias("_at", "snippet"))
    substitution = F.contains("snippet", F.lit("→")) & ~F.col("snippet").rlike("^[+-]")
    stamps = said.where(substitution).groupBy(*k, "snippet").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    kept = said.join(stamps.select(*k, "snippet"), [*k, "snippet"], "left_anti").groupBy(*of).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "snippet"))), lambda x: x["snippet"]).alias("_kept"))
    rows = sections.join(kept, of, "left")
    had = (F.col("change_type") == "modified") & (F.size("snippets") > 0)
    left = F.when(had, F.coalesce("_kept", F.array().cast("array<string>"))).otherwise(F.col("snippets"))
    nothing = had & (F.size(left) == 0) & (F.coalesce("value_changes", F.lit(0)) == 0) & (F.coalesce("tbd_changes", F.lit(0)) == 0)
    out = rows.withColumn("_left", left).withColumn("_no", nothing)
    out = out.withColumn("change_type", F.when(F.col("_no"), "unchanged").otherwise(F.col("change_type"))).withColumn("classification", F.when(F.col("_no"), "editorial").otherwise(F.col("classification")))
    out = out.withColumn("has_requirement_change", F.when(F.col("_no"), False).otherwise(F.col("has_requirement_change"))).withColumn("snippets", F.col("_left"))
    return out.select(*sections.columns), stamps


def spec_values(blocks: DataFrame, around: int = 60) -> DataFrame:
    """(doc, page, ord, block_id, n, value, unit, context, keywords): numbers with units, then tolerances with ± before their unit."""

    def of(pattern: str, kind: int, sign: str):
        rows = blocks.where((F.length("text") >= 3) & F.col("text").rlike(pattern)).select("doc", "page", "ord", "block_id", "text", F.posexplode(F.arrays_zip(T.spans("text", pattern).alias("s"), T.found("text", pattern, 1).alias("v"), T.found("text", pattern, 2).alias("u"))).alias("n", "m"))
        ctx = T.context("text", F.col("m.s.start"), F.col("m.s.end"), around)
        return rows.select("doc", "page", "ord", "block_id", F.lit(kind).alias("kind"), "n", F.col("m.v").cast("double").alias("value"), F.concat(F.lit(sign), F.col("m.u")).alias("unit"), ctx.alias("context"), T.keywords(ctx).alias("keywords"))

    return of(T.VALUE_PATTERN, 0, "").unionByName(of(T.TOLERANCE_PATTERN, 1, "±"))


def match_values(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Changed values between two versions of spec_values rows: (keys, unit, old_value, new_value, context).

    For each old value in order, the new value of its unit (± aside) with most shared keywords, two at least,
    the first of several; a new value is used up only by a differing match. Rows come sorted by keys and unit and are folded as they stream by; new values with the same keywords stand in one
    queue, of which only the first can match, so a large group does not take the square of its size unless its keywords all differ.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    group = [*keys, "base"]
    words = F.array_join(F.array_sort(F.array_distinct(F.filter("keywords", lambda w: w.isNotNull()))), " ").alias("words")
    side = lambda d, n: d.select(*keys, F.regexp_replace("unit", "^±", "").alias("base"), F.lit(n).alias("side"), "page", "ord", "kind", "n", "value", "unit", "context", words)
    rows = side(new, 0).unionByName(side(old, 1)).repartition(*group).sortWithinPartitions(*group, "side", "page", "ord", "kind", "n").select(*group, "side", "value", "unit", "context", "words")
    out = to_arrow_schema(schema := StructType.fromDDL(", ".join(f"{k} {dict(old.dtypes)[k]}" for k in keys) + ", unit string, old_value double, new_value double, context string"))

    def fold(it):
        at, sets = None, {}  # sets: of a group's new values by their keywords, places and values in order and how many of them are used up
        for batch in it:
            found = []
            columns = [c.to_pylist() for c in batch.columns]
            for row in zip(*columns):
                key, (old_side, value, unit, context, text) = row[:len(group)], row[len(group):]
                if key != at:
                    at, sets, near, place = key, {}, {}, 0
                if not old_side:
                    sets.setdefault(text, [[], 0])[0].append((place, value))
                    place += 1
                    continue
                if text not in near:
                    mine = set(text.split())
                    near[text] = sorted(((-n, t) for t in sets if (n := len(mine.intersection(t.split()))) >= 2))
                best, least = None, 0
                for less, t in near[text]:
                    if best is not None and less != least:
                        break
                    values, used = sets[t]
                    if used < len(values) and (best is None or values[used][0] < sets[best][0][sets[best][1]][0]):
                        best, least = t, less
                if best is not None:
                    values, used = sets[best]
                    if values[used][1] != value:
                        sets[best][1] += 1
                        found.append((*key[:-1], unit, value, values[used][1], context))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found) if found else [[]] * len(out), out)], schema=out)

    return rows.mapInArrow(fold, schema)


def heading(blocks: DataFrame) -> Column:
    """Large and short, or, if not large, like a numbered or capital heading and shorter."""
    t = F.trim("text")
    return F.when(F.col("font_size") > 12, F.length(t) < 100).otherwise(t.rlike(r"^(\d+(\.\d+)*\.?\s+[A-Z]|[A-Z][A-Z\s]{4,}$)") & (F.length(t) < 80))


def segments(blocks: DataFrame) -> DataFrame:
    """(doc, seg, heading, page, n_blocks) of sections with blocks; before the first heading stands Preamble."""
    rows = blocks.where(F.trim("text") != "").withColumn("h", heading(blocks))
    w = Window.partitionBy("doc").orderBy("page", "ord")
    rows = rows.withColumn("seg", F.sum(F.col("h").cast("int")).over(w))
    g = rows.groupBy("doc", "seg").agg(F.max(F.when(F.col("h"), F.trim("text"))).alias("heading"), F.min(F.when(F.col("h"), F.col("page"))).alias("page"), F.count_if(~F.col("h")).alias("n_blocks"))
    return g.where("n_blocks > 0").select("doc", "seg", F.coalesce("heading", F.lit("Preamble")).alias("heading"), F.coalesce("page", F.lit(1)).alias("page"), "n_blocks")


def rating(score: Column) -> Column:
    return F.when(score >= 0.95, "high").when(score >= 0.80, "medium").otherwise("low")


def maturity(blocks: DataFrame, items: DataFrame) -> DataFrame:
    """Per section and overall: blocks, open items on or after its first page that stand there or share a word with its heading, score and rating.

    An item may count in several sections. A document without counted blocks has an overall row of score 1.
    """
    segs = segments(blocks).withColumn("hw", T.heading_words("heading"))
    found = items.select("doc", F.col("page").alias("item_page"), T.heading_words("context").alias("cw"))
    near = (F.col("item_page") == F.col("page")) | ((F.col("item_page") > F.col("page")) & F.arrays_overlap("hw", "cw"))
    hits = segs.join(found, "doc").where(near).groupBy("doc", "seg").agg(F.count("*").alias("n_items"))
    rows = segs.join(hits, ["doc", "seg"], "left").withColumn("n_items", F.coalesce("n_items", F.lit(0).cast("long")))
    total = rows.groupBy("doc").agg(F.sum("n_blocks").alias("n_blocks"), F.sum("n_items").alias("n_items"))
    total = blocks.select("doc").distinct().join(total, "doc", "left").fillna(0, ["n_blocks", "n_items"]).withColumn("seg", F.lit(-1).cast("long")).withColumn("heading", F.lit("overall"))
    both = rows.select("doc", "seg", "heading", "n_blocks", "n_items").unionByName(total)
    score = F.greatest(F.lit(0.0), 1 - F.col("n_items") / F.greatest(F.col("n_blocks"), F.lit(1)))
    return both.withColumn("score", F.round(score, 3)).withColumn("rating", rating(score))


#: Terms of an automaton, and texts that one task scans with it.
TERMS, TEXTS = 100_000, 20_000


def contained(texts: DataFrame, terms: DataFrame, block: int = TERMS, slot: int = TEXTS) -> DataFrame:
    """(text_id, term_id) for each term (term_id, term) that stands in a text (text_id, text), wherever it begins; upper and lower case are alike.

    Terms are dealt into blocks, texts into slots; each slot meets each block in one task, which builds one automaton of the
    block's terms and reads each text once. Null and empty terms and texts contain nothing.
    """
    import ahocorasick
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    texts = texts.select("text_id", F.lower("text").alias("text")).where("text <> ''")
    terms = terms.select("term_id", F.lower("term").alias("term")).where("term <> ''")
    blocks, slots = max(1, -(-terms.count() // block)), max(1, -(-texts.count() // slot))
    spread = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    t = terms.withColumn("block", spread("term", blocks)).withColumn("slot", every(slots))
    p = texts.withColumn("slot", spread("text_id", slots)).withColumn("block", every(blocks))

    def run(pages, names):
        words = ahocorasick.Automaton()
        held: dict[str, list] = {}
        for place, w in enumerate(names.column("term").to_pylist()):
            held.setdefault(w, []).append(place)
        for w in held:
            words.add_word(w, w)
        texts_at, terms_at = [], []
        if held:
            words.make_automaton()
            for place, x in enumerate(pages.column("text").to_pylist()):
                for w in {w for _, w in words.iter(x)}:
                    texts_at.extend([place] * len(held[w]))
                    terms_at.extend(held[w])
        ids = [c.take(pa.array(at, pa.int64())).to_pylist() for c, at in ((pages.column("text_id"), texts_at), (names.column("term_id"), terms_at))]
        return pa.table([pa.array(x, f.type) for x, f in zip(ids, result)], schema=result)

    result = to_arrow_schema(schema := StructType.fromDDL(", ".join(f"{c} {dict(d.dtypes)[c]}" for d, c in ((texts, "text_id"), (terms, "term_id")))))
    return p.groupBy("block", "slot").cogroup(t.groupBy("block", "slot")).applyInArrow(run, schema)


def _mentions(pages: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc, page, target, term): of the terms of another document that stand on a page the first in order."""
    t = terms.where(F.length(F.trim("term")) >= 3).select(F.struct("target", "ord", "term").alias("term_id"), "term")
    hits = contained(pages.select(F.struct("doc", "page").alias("text_id"), "text"), t)
    hits = hits.select("text_id.doc", "text_id.page", "term_id.target", "term_id.ord", "term_id.term").where(F.col("doc") != F.col("target"))
    return hits.groupBy("doc", "page", "target").agg(F.min(F.struct("ord", "term")).alias("m")).select("doc", "page", "target", "m.term")


def cross_references(pages: DataFrame, terms: DataFrame, sections: DataFrame | None = None) -> DataFrame:
    """(doc, page, target, term, ref_type): pages (doc, page, text) that name another document by one of its terms (target, ord, term), the first that occurs.

    ``sections`` are the texts of reference sections (doc, page, text). What they name is an applicable_document; a page where a section names a document has no
    inline_mention of the same one. Terms are found wherever they stand, also inside words; those of fewer than three characters are left out.
    """
    inline = _mentions(pages, terms).withColumn("ref_type", F.lit("inline_mention"))
    if sections is None:
        return inline
    applicable = _mentions(sections, terms).withColumn("ref_type", F.lit("applicable_document"))
    return applicable.unionByName(inline.join(applicable.select("doc", "page", "target"), ["doc", "page", "target"], "left_anti"))


#: Characters by which names and titles find each other.
GRAM = 10
#: Bits of the filter by which texts drop keys that no term has: at most 2**24 / 64 = 262,144 rows of 16 bytes, whatever the input.
KEY_BITS = 24


def _kept(df: DataFrame, tag: str) -> DataFrame:
    """The rows, written once and read from there."""
    df.write.parquet(path := scratch(df.sparkSession, tag))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _known(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows without most of those whose key is not among ``keys``, before they are shuffled; one hash a key, so some others stay."""
    h = F.pmod(F.xxhash64("key"), F.lit(1 << KEY_BITS))
    words = keys.select(h.alias("_h")).groupBy(F.shiftright("_h", 6).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_h & 63 as int))")).alias("_bits"))
    hit = (F.shiftright("_h", 6) == F.col("_word")) & (F.expr("shiftright(_bits, cast(_h & 63 as int)) & 1") == 1)
    return rows.withColumn("_h", h).join(F.broadcast(_kept(words, "keys")), hit).select(*rows.columns)


def _holding(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(text, term) for each term that stands in a text, of distinct texts and terms that may repeat, neither empty.

    A term's key is its first GRAM characters, or all where it has fewer; a text meets the keys that it holds, of the lengths that terms have. So what is shuffled grows
    with the characters of the texts, not with texts times terms, and mostly holds keys that a term has. Case counts.
    The join is by sorting, whatever the threshold for broadcasts: Spark takes the keys of a text to be no larger than the text, or than the file that it came from.
    """
    keyed = terms.withColumn("key", F.substring("term", 1, GRAM))
    lengths = sorted(r[0] for r in keyed.select(F.length("key")).distinct().collect())  # GRAM at most
    every = lambda n: F.transform(F.sequence(F.lit(1), F.length("text") - (n - 1)), lambda i: F.substring(F.col("text"), i, F.lit(n)))
    cut = [F.when(F.length("text") >= n, every(n)).otherwise(F.array().cast("array<string>")) for n in lengths]
    keys = texts.select("text", F.explode(F.array_distinct(F.concat(F.array().cast("array<string>"), *cut))).alias("key"))
    return _known(keys, keyed).join(keyed.distinct().hint("merge"), "key").where(F.contains("text", F.col("term"))).select("text", "term")


def title_counts(stems: DataFrame, items: DataFrame) -> DataFrame:
    """(stem, item_type, n): items (title, item_type) of each document by name: the stem or its first ten characters stand in the title, or the title in the stem.

    Documents without items have no row; empty names and titles belong to nothing. Titles that repeat are compared once. Items and stems are read once; their counts and
    names are tables in the folder of ``spark.checkpoint.dir``. No names or titles go through the driver, whatever the threshold for broadcasts.
    """
    counted = _kept(items.where("title <> ''").groupBy(F.lower("title").alias("title"), "item_type").agg(F.count("*").alias("n")), "titles")
    names = _kept(stems.select(F.lower("stem").alias("low"), "stem").where("low <> ''").distinct(), "names")
    start = F.substring("low", 1, 10)  # a stem that stands in a title does so with its beginning
    inside = _holding(counted.select(F.col("title").alias("text")).distinct(), names.select(start.alias("term"))).select(F.col("text").alias("title"), F.col("term").alias("start"))
    around = _holding(names.select(F.col("low").alias("text")).distinct(), counted.select(F.col("title").alias("term"))).select(F.col("term").alias("title"), F.col("text").alias("low"))
    held = names.withColumn("start", start).hint("merge").join(inside, "start").select("title", "stem").unionByName(names.hint("merge").join(around, "low").select("title", "stem"))
    return held.distinct().join(counted.hint("merge"), "title").groupBy("stem", "item_type").agg(F.sum("n").alias("n"))


def quick_compare(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Overlap of the words, case kept, of two first pages (key, filename, text and, where known, pages) and whether they are related: above 0.3, or of one family by name.

    Revisions are those in the first 500 characters, empty if there is none. Page counts are compared where both sides have ``pages``.
    """
    w = lambda c: F.array_distinct(T.words(c))
    counts = "pages" in a.columns and "pages" in b.columns

    def side(d, n):
        more = [F.col("pages").alias(f"pages_{n}")] if counts else []
        return d.select(key, w("text").alias(f"w_{n}"), T.normalized_stem("filename").alias(f"f_{n}"), T.revision(F.substring(F.coalesce("text", F.lit("")), 1, 500)).alias(f"revision_{n}"), *more)

    rows = side(a, "a").join(side(b, "b"), key).withColumn("s", T.jaccard(F.col("w_a"), F.col("w_b")))
    pages = ["pages_a", "pages_b", (F.col("pages_a") == F.col("pages_b")).alias("page_count_match")] if counts else []
    return rows.select(key, F.round("s", 3).alias("similarity"), ((F.col("s") > 0.3) | F.col("f_a").eqNullSafe(F.col("f_b"))).alias("related"), "revision_a", "revision_b", *pages)


def summary(documents: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """(doc, stem, filename, revision, date, page_count, tbd_count, tbr_count) of documents (doc, filename, text of the first page, pages): the row of a briefing.

    With ``items`` (doc, item_type) their numbers, else zeros.
    """
    head = F.substring(F.coalesce("text", F.lit("")), 1, 500)
    rows = documents.select("doc", T.stem("filename").alias("stem"), "filename", T.revision(head).alias("revision"), T.date_text(head).alias("date"), F.col("pages").alias("page_count"))
    if items is None:
        return rows.withColumn("tbd_count", F.lit(0).cast("long")).withColumn("tbr_count", F.lit(0).cast("long"))
    n = items.groupBy("doc").agg(F.count_if(F.col("item_type") == "TBD").alias("tbd_count"), F.count_if(F.col("item_type") == "TBR").alias("tbr_count"))
    return rows.join(n, "doc", "left").fillna(0, ["tbd_count", "tbr_count"])


def gather(documents: DataFrame, items: DataFrame, stems: list[str] | DataFrame) -> tuple[DataFrame, DataFrame]:
    """A briefing of the documents named by their stems, in a list or a table (stem): their summaries, and all their open items with the stem. Stems that no document has are passed over."""
    rows = summary(documents, items)
    wanted = rows.join(stems.select("stem"), "stem", "left_semi").select(*rows.columns) if isinstance(stems, DataFrame) else rows.where(F.col("stem").isin(list(stems)))
    return wanted, items.join(wanted.select("doc", "stem"), "doc")


def word_report(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Words lost and gained between two texts and the share kept."""
    w = lambda c: F.array_distinct(T.words(c))
    rows = a.select(key, w("text").alias("x"), F.col("text").alias("ta")).join(b.select(key, w("text").alias("y"), F.col("text").alias("tb")), key)
    squeeze = lambda c: F.array_join(T.words(c), " ")
    state = F.when(F.col("ta") == F.col("tb"), "exact").when(squeeze("ta") == squeeze("tb"), "whitespace").otherwise("differs")
    return rows.select(key, F.array_sort(F.array_except("x", "y")).alias("missing"), F.array_sort(F.array_except("y", "x")).alias("extra"), F.round(F.size(F.array_intersect("x", "y")) / F.greatest(F.size("x"), F.lit(1)), 9).alias("retention"), state.alias("state"))


def text_totals(report: DataFrame, *keys: str) -> DataFrame:
    """Totals of a document's page comparisons (keys, page, n_words, missing, extra, state): pages, exact ones, distinct words by page, lost and new ones, share kept in percent, and the pages that keep most and least.

    Of pages that keep alike the first counts. A document without words keeps all. A page without words keeps 100 %.
    """
    lost, fresh = F.size("missing"), F.size("extra")
    kept = F.when(F.col("n_words") > 0, (F.col("n_words") - lost) / F.col("n_words") * 100).otherwise(100.0)
    g = report.withColumn("kept", kept).groupBy(*keys).agg(
        F.count("*").alias("pages"), F.count_if(F.col("state") == "exact").alias("exact"), F.count_if(F.col("state") == "whitespace").alias("whitespace"), F.count_if(F.col("state") == "differs").alias("differs"),
        F.sum("n_words").alias("words"), F.sum(lost).alias("missing_words"), F.sum(fresh).alias("extra_words"),
        F.min(F.struct((-F.col("kept")).alias("k"), "page")).alias("b"), F.min(F.struct(F.col("kept").alias("k"), "page")).alias("w"), F.avg("kept").alias("mean_retention"),
    )
    share = F.when(F.col("words") > 0, (F.col("words") - F.col("missing_words")) / F.col("words") * 100).otherwise(100.0)
    return g.select(*keys, "pages", "exact", "whitespace", "differs", "words", "missing_words", "extra_words", F.round(share, 6).alias("word_retention"), F.round("mean_retention", 6).alias("mean_retention"), F.col("b.page").alias("best_page"), F.col("w.page").alias("worst_page"))


def page_report(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """(keys, page, n_words, missing, extra, state) of pages (keys, page, text) that both versions have: the words lost and gained, sorted, and whether the texts are exact but for white space, have the same words, or differ."""
    k = [*keys, "page"]
    plain = lambda c: F.array_join(T.words(c), " ")
    rows = a.select(*k, F.col("text").alias("ta")).join(b.select(*k, F.col("text").alias("tb")), k)
    rows = rows.withColumn("x", F.array_distinct(T.words("ta"))).withColumn("y", F.array_distinct(T.words("tb")))
    rows = rows.withColumn("missing", F.array_sort(F.array_except("x", "y"))).withColumn("extra", F.array_sort(F.array_except("y", "x")))
    same = (F.size("missing") == 0) & (F.size("extra") == 0)
    return rows.select(*k, F.size("x").alias("n_words"), "missing", "extra", F.when(plain("ta") == plain("tb"), "exact").when(same, "whitespace").otherwise("differs").alias("state"))


def text_report(report: DataFrame, totals: DataFrame, *keys: str, names: int = 3) -> DataFrame:
    """(keys, report): the text-accuracy report of each document in Markdown: a table of its pages, naming at most ``names`` words of each kind, and the summary. A document's pages make one row."""
    named = lambda c, label: F.when(F.size(c) > 0, F.concat(F.lit(f"{label}: "), F.array_join(F.slice(c, 1, names), ", ")))
    status = F.when(F.col("state") == "exact", "Exact").when(F.col("state") == "whitespace", "Whitespace").otherwise("Differs")
    line = F.concat_ws(" | ", F.concat(F.lit("| "), "page"), status, "n_words", F.size("missing").cast("string"), F.size("extra").cast("string"), F.concat(F.concat_ws("; ", named("missing", "Missing"), named("extra", "Extra")), F.lit(" |")))
    pages = report.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("page", line.alias("line")))).alias("lines"))
    head = "## Per-Page Results\n\n| Page | Status | Words Orig | Missing | Extra | Notes |\n|------|--------|-----------|---------|-------|-------|\n"
    rows = [("Pages with exact text match", F.concat("exact", F.lit("/"), "pages")), ("Word retention", F.concat(F.format_number("word_retention", 1), F.lit("%"))), ("Total unique words in original", F.col("words").cast("string")), ("Total missing words", F.col("missing_words").cast("string")), ("Total extra words", F.col("extra_words").cast("string"))]
    summary = F.concat(F.lit("\n\n## Summary\n\n| Metric | Value |\n|--------|-------|"), *[F.concat(F.lit(f"\n| {n} | "), v, F.lit(" |")) for n, v in rows])
    both = pages.join(totals, list(keys))
    return both.select(*keys, F.concat(F.lit(head), F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), summary).alias("report"))


def revision_totals(compared: DataFrame, *keys: str) -> DataFrame:
    """Totals of a comparison's sections (as ``compare_sections`` gives them) with the words of old and new texts and their overlap as sets, rounded to three places."""
    word = lambda c: T.words(F.coalesce(F.col(c), F.lit("")))
    n = lambda v: F.count_if(F.col("change_type") == v).alias(v)
    g = compared.groupBy(*keys).agg(
        n("added"), n("removed"), n("modified"), n("unchanged"), F.count_if("has_requirement_change").alias("requirement_changes"), F.count_if("has_tbd_change").alias("tbd_changes"), F.count_if(F.col("classification") == "technical").alias("technical"),
        F.sum(F.size(word("old_text"))).alias("old_words"), F.sum(F.size(word("new_text"))).alias("new_words"),
    )
    side = lambda c, f: compared.select(*keys, F.explode(F.array_distinct(word(c))).alias("_w")).distinct().withColumn(f, F.lit(True))
    met = side("old_text", "a").join(side("new_text", "b"), [*keys, "_w"], "full_outer").groupBy(*keys).agg(F.count_if(F.col("a") & F.col("b")).alias("both"), F.count("*").alias("all"))
    return g.join(met, list(keys), "left").withColumn("word_similarity", F.round(F.coalesce(F.col("both") / F.col("all"), F.lit(0.0)), 3)).drop("both", "all")
