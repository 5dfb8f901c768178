"""The queries of this package and their SQL."""

from __future__ import annotations

from . import byte_bpe, exact_dedup, hard_negatives, language_id, licenses, masked_lm, mixing, mtree, near_dedup, packing, periodic, sstable, toxicity

MODULES = [mtree, exact_dedup, near_dedup, packing, sstable, language_id, toxicity, licenses, masked_lm, mixing, periodic, byte_bpe, hard_negatives]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in vars(m).items() if name.startswith("op") and name[2:3].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLE.items()}
