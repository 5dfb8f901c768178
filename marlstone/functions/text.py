"""Text functions as columns: no Python runs on the rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+"

# Words without meaning for keywords, and for the overlap of headings with contexts.
KEYWORD_STOP = (
    "the and for are but not you all can had her was one our this that with from have been will shall must may should per each than its "
    "also between into any only over such after before other which their there when what where more less most tbd tbr tbc tbs ref see note"
).split()
HEADING_STOP = "the and for are but not you all can had her was one our this that with from have been".split()
# Suffixes that do not belong to a document's name, in the order they are taken off.
STEM_SUFFIXES = (
    ["_flat", "_flattened", "_scanned"] + [f"_v{i}" for i in range(1, 6)] + [f"_rev{c}" for c in "abcdefgh"] + ["_draft", "_final", "_baseline", "_digital", "_ocr"]
)
# Units of specification values and of tolerances, and of the change classifier.
UNITS = (
    "V kV mV W kW mW A mA µA MHz GHz kHz Hz Mbps kbps bps Gbps mm cm m km µm kg g mg lb lbs °C °F K psi Pa kPa MPa atm ft-lb Nm N kN dB dBm dBW "
    "ms µs ns s min hr deg rad Ohm kOhm MOhm bits? bytes? KB MB GB TB"
).split()
TOLERANCE_UNITS = "mm cm m µm °C °F K V mV A mA deg %".split()
CHANGE_UNITS = (
    "V kV mV W kW mW mA µA MHz GHz kHz Mbps kbps mm cm µm kg mg °C °F psi kPa MPa atm ft-lb Nm kN ohm Ω ns ms µs sec msec dB dBm Hz"
).split()
VALUE_PATTERN = r"(?U)([+-]?\d+\.?\d*)\s*(" + "|".join(UNITS) + r")\b"
TOLERANCE_PATTERN = r"(?U)[±]\s*(\d+\.?\d*)\s*(" + "|".join(TOLERANCE_UNITS) + ")"
CHANGE_PATTERN = r"(?U)(?<!\w)(\d+\.?\d*)\s*(" + "|".join(CHANGE_UNITS) + r")\b"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def found(text: Column | str, pattern: str, group: int = 0) -> Column:
    """All matches of a pattern; null text has none."""
    return F.coalesce(F.regexp_extract_all(col(text), F.lit(pattern), F.lit(group)), F.array().cast("array<string>"))


def words(text: Column | str) -> Column:
    return found(text, r"\S+")


def tokens(text: Column | str) -> Column:
    """Lower-case runs of letters and digits."""
    return found(F.lower(col(text)), TOKEN)


def token_estimate(text: Column | str) -> Column:
    """Words times 1.3, cut to an integer."""
    return F.floor(F.size(words(text)) * 13 / 10).cast("long")


def keywords(text: Column | str) -> Column:
    """Lower-case alphabetic words of three letters or more without stop words; repeats stay."""
    return F.filter(found(F.lower(col(text)), r"\b[a-zA-Z]{3,}\b"), lambda w: ~w.isin(KEYWORD_STOP))


def heading_words(text: Column | str) -> Column:
    return F.filter(F.array_distinct(found(F.lower(col(text)), r"(?U)\b\w{3,}\b")), lambda w: ~w.isin(HEADING_STOP))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two arrays as sets; nothing against nothing is 0."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def first_match(text: Column | str, *patterns: str) -> Column:
    """Group 1 of the first pattern that matches, else an empty string."""
    return F.coalesce(*[F.nullif(F.regexp_extract(col(text), p, 1), F.lit("")) for p in patterns], F.lit(""))


def revision(text: Column | str) -> Column:
    return first_match(text, r"[Rr]ev(?:ision)?[\s.:]*([A-Z])\b", r"[Rr]ev(?:ision)?[\s.:]*(\d+)", r"[Vv]ersion[\s.:]*(\d+(?:\.\d+)*)")


def date_text(text: Column | str) -> Column:
    """A date as written: word and year before ISO before US form, wherever they stand."""
    return first_match(text, r"(\w+ \d{4})", r"(\d{4}-\d{2}-\d{2})", r"(\d{2}/\d{2}/\d{4})")


def stem(filename: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(col(filename), r"^.*/", ""), r"(?<=.)\.[^.]*$", "")


def revision_from_filename(filename: Column | str) -> Column:
    return first_match(stem(filename), r"_[Rr]ev([A-Z])", r"\d([A-Z])$")


def normalized_stem(filename: Column | str) -> Column:
    """Name of the document family: suffixes come off in one ordered pass, then a date, a revision and a letter after digits."""
    out = F.lower(stem(filename))
    for s in STEM_SUFFIXES:
        out = F.regexp_replace(out, s + "$", "")
    for p, to in ((r"_\d{8}$", ""), (r"_rev[a-z]$", ""), (r"(\d{2,})[a-z]$", "$1")):
        out = F.regexp_replace(out, p, to)
    return out


def document_number(filename: Column | str) -> Column:
    """Stem without a revision suffix, underscores as blanks."""
    return F.replace(F.regexp_replace(stem(filename), r"(?i)_?rev[a-z]$", ""), F.lit("_"), F.lit(" "))


def section_number(heading: Column | str) -> Column:
    return F.nullif(F.regexp_extract(col(heading), r"^(\d+(?:\.\d+)*)\s", 1), F.lit(""))


def spans(text: Column | str, pattern: str) -> Column:
    """Matches with their places: array of (match, start, end), start from 0.

    The pieces between matches and the matches interleave, so a match starts after all pieces up to it
    and all matches before it. The pattern must have no empty match.
    """
    t = col(text)
    hits, parts = found(t, pattern), F.split(t, pattern, -1)
    start = F.aggregate(
        F.sequence(F.lit(1), F.size(hits)),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<match:string,start:int,end:int>>").alias("out")),
        lambda acc, i: F.struct(
            (acc["at"] + F.length(F.element_at(parts, i)) + F.length(F.element_at(hits, i))).alias("at"),
            F.concat(
                acc["out"],
                F.array(
                    F.struct(
                        F.element_at(hits, i).alias("match"),
                        (acc["at"] + F.length(F.element_at(parts, i))).cast("int").alias("start"),
                        (acc["at"] + F.length(F.element_at(parts, i)) + F.length(F.element_at(hits, i))).cast("int").alias("end"),
                    )
                ),
            ).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return F.when(F.size(hits) > 0, start).otherwise(F.array().cast("array<struct<match:string,start:int,end:int>>"))


def context(text: Column | str, start: Column, end: Column, around: int) -> Column:
    """Text around a span, line breaks as blanks, trimmed."""
    lo = F.greatest(start - around, F.lit(0))
    return F.trim(F.replace(F.substring(col(text), lo + 1, end + around - lo), F.lit("\n"), F.lit(" ")))
