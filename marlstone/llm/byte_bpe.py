"""Byte-level BPE ids of whole texts by a local rank file, and the bytes back from ids.

The tiktoken library encodes; each match of the splitting pattern is merged by itself. A long text goes
to the library in parts, cut only where a match ends whatever stands around: between a visible character
and white space, between kinds of ASCII characters, between CJK letters and CJK marks, and before the
last character of a run of white space. A very long run of white space, on which the library's matcher
runs out of stack, is one match by the pattern's rules and is merged as such. Decoding joins the bytes
of the ids, so ids whose bytes end inside a character decode too.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .common import table

RANKS = "byte_bpe_50k.tiktoken"
#: Characters of a part of a long text, and of a run of white space that is merged without the matcher.
PART, RUN = 1 << 20, 1 << 15

# The characters of Unicode's property White_Space.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WHITE_RUN = regex.compile(f"[{WHITE}]{{{RUN},}}")
_CJK = r"ぁ-ゖァ-ヺ一-龥"
#: Places where a match of the pattern ends in every context.
_SAFE = regex.compile(
    r"(?<=[!-~])(?=[ \t\n\r])"  # the end of a word
    r"|(?<=[A-Za-z])(?=[!-@\[-`{-~])|(?<=[0-9])(?=[!-/:-~])"  # after letters, after digits
    r"|(?<=[!-&(-/:-@\[-`{-~])(?=[0-9A-Za-z])|(?<=')(?=[0-9])"  # after marks; an apostrophe may begin a contraction
    rf"|(?<=[{_CJK}])(?=[、。！，？])|(?<=[、。！，？])(?=[{_CJK}])"
    r"|(?<=[ \t\n\r])(?=[ \t\n\r][!-~])"  # the last white space of a run may belong to what follows
)


class Codec:
    """Encodes texts to uint32 ids and decodes ids to bytes by one rank file."""

    def __init__(self, path: str, pattern: str):
        self.path, self.pattern = path, pattern

    def _ranks(self) -> Iterator[tuple[bytes, int]]:
        with open(self.path, "rb") as f:
            for token, rank in map(bytes.split, f):
                yield base64.b64decode(token), int(rank)

    @cached_property
    def split(self) -> tiktoken.Encoding:
        return tiktoken.Encoding("split", pat_str=self.pattern, mergeable_ranks=dict(self._ranks()), special_tokens={})

    @cached_property
    def whole(self) -> tiktoken.Encoding:
        """Merges a text as one match."""
        return tiktoken.Encoding("whole", pat_str=r"(?s:.+)", mergeable_ranks=dict(self._ranks()), special_tokens={})

    @cached_property
    def bytes(self) -> dict[int, bytes]:
        return {rank: token for token, rank in self._ranks()}

    def parts(self, text: str) -> Iterator[tuple[str, bool]]:
        """Parts of a text in order, and whether a part is one match; the ids of the parts are those of the text."""
        at = 0
        for run in _WHITE_RUN.finditer(text):
            end = run.end() if run.end() == len(text) else run.end() - 1
            yield from ((p, False) for p in self._cut(text, at, run.start()))
            yield text[run.start() : end], True
            at = end
        yield from ((p, False) for p in self._cut(text, at, len(text)))

    @staticmethod
    def _cut(text: str, at: int, end: int) -> Iterator[str]:
        while end - at > PART:
            # A match needs the character before and up to two after; the end itself is a place to stop.
            found = _SAFE.search(text, at + PART, end)
            to = found.start() if found else end
            yield text[at:to]
            at = to
        if at < end:
            yield text[at:end]

    def encode(self, text: str) -> list[int]:
        if len(text) < RUN:
            return self.split.encode_ordinary(text)
        return list(chain.from_iterable((self.whole if one else self.split).encode_ordinary(p) for p, one in self.parts(text)))

    def packed(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian uint32."""
        return [np.array(self.encode(t), "<u4").tobytes() for t in texts]

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the ids; ValueError for a number that is no id."""
        try:
            return b"".join(map(self.bytes.__getitem__, ids.tolist()))
        except KeyError as e:
            raise ValueError(f"{e.args[0]} is not an id of this vocabulary") from None


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str = public_tokenizers.PATTERN) -> Codec:
    """One codec for each rank file and Python worker."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def _mapped(df: DataFrame, source: str, result: str, of):
    """df with column ``source`` replaced by the binary column ``result``; ``of`` turns an Arrow column into values."""
    kept = [c for c in df.columns if c != source]

    def run(batches):
        for batch in batches:
            for piece in tk.pieces(batch, source):
                yield pa.RecordBatch.from_arrays([*[piece.column(c) for c in kept], pa.array(of(piece.column(source)), pa.binary())], names=[*kept, result])

    schema = df.select(*kept).withColumn(result, F.lit(None).cast("binary")).schema
    return df.mapInArrow(run, schema)


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", ranks: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(key, ids): the ids of every whole text as little-endian uint32 in a binary column.

    A null text counts as empty and has no ids. Every row is encoded, repeated rows and rows without a key too;
    other columns are left out. Ids of a row take up to four bytes a byte of text, and a binary value holds 2 GB:
    texts beyond 512 MB fail. ``ranks`` is the path of a rank file that executors can read.
    """
    path = ranks or public_tokenizers.path(RANKS)
    return _mapped(docs.select(F.col(key), F.col(text).cast("string").alias("_text")), "_text", "ids", lambda c: codec(path, pattern).packed([t or "" for t in c.to_pylist()]))


def decode(encoded: DataFrame, ids: str = "ids", ranks: str | None = None, keep: bool = True) -> DataFrame:
    """Rows with ``bytes``, what the ids stand for; null ids count as none. ``keep=False`` leaves the ids out."""
    path = ranks or public_tokenizers.path(RANKS)
    rows = encoded.withColumn("_ids", F.col(ids)) if keep else encoded.withColumnRenamed(ids, "_ids")
    return _mapped(rows, "_ids", "bytes", lambda c: [codec(path).decode(np.frombuffer(x or b"", "<u4")) for x in c.to_pylist()])


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = decode(encode(table(spark, sf_dir, "documents")))
    size = (F.octet_length("ids") / 4).cast("long")
    return coded.select("doc_id", size.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


#: The library's merges are beyond SQL; tests hold the query against it, text by text.
ORACLE: dict[str, str] = {}
