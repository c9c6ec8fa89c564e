"""All queries of this folder; importing it registers them."""

from wavetable.llm import chat, decontaminate, divergence, jaccard, langid, mixing, sharding, substrings, suffixes, tokens, trie, vectors, warc  # noqa: F401
from wavetable.llm.common import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
