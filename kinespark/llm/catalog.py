"""All queries of this folder; importing the modules registers them."""

from kinespark.llm import (  # noqa: F401
    alignment, byte_bpe, exact_dedup, jaccard_join, mixing, pieces, prefix_trie, quality_model, quality_rules,
    secret_scan, suffix_dedup, token_counts, warc,
)
from kinespark.llm.common import QUERIES, SQL  # noqa: F401
