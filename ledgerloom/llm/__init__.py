"""Operators of a training-data pipeline. QUERIES and SQL join what the modules register."""

from . import byte_bpe, chat_format, exact_dedup, line_dedup, near_dedup, neighbours, packing, periodic_runs, prefix_trie, quality, secrets, sharding, toxicity

_MODULES = [near_dedup, quality, line_dedup, neighbours, exact_dedup, sharding, secrets, packing, toxicity, byte_bpe, prefix_trie, periodic_runs, chat_format]
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}
