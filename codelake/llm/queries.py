"""Imports every operator module, so that its query registers itself."""

from __future__ import annotations

from codelake.llm import byte_bpe, language_id, licenses, media, merkle, minhash_forest, ngram_join, packing, pii, quality_rules, suffix_dedup, token_align, url_filters  # noqa: F401
from codelake.llm.registry import ORACLES, QUERIES  # noqa: F401
