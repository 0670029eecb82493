"""All queries of the corpus operators; importing the module fills the registry."""

from sluice.llm import exact_dedup, language_id, license_scan, lm_scoring, mixing, near_dedup, packing, prefix_trie, ranked_search, substring_dedup, token_output, topk_search, toxicity  # noqa: F401
from sluice.llm.base import ORACLES, QUERIES  # noqa: F401
