"""Importing this module fills the registry of the training-data queries."""

from parley.llm.registry import ORACLES, QUERIES  # noqa: F401
from parley.llm import best_fit, byte_bpe, chat_format, chat_repair, exact_dedup, id_files, jaccard_join, lang_unigram, main_text, minhash, pu_quality, spelling, token_counts  # noqa: F401, I001
