"""Queries of this folder, and their SQL where SQL can express them."""

from __future__ import annotations

from .filter_audit import OP12_SQL, op12_filter_audit
from .jaccard_join import op2_jaccard_join
from .language_id import op4_language_id
from .line_dedup import OP6_SQL, op6_line_dedup
from .mixing import OP5_SQL, op5_mix_sources
from .periodic_runs import op13_periodic_runs
from .pseudonyms import op10_pseudonyms
from .quality import op9_quality
from .shard_shuffle import op11_shard_shuffle
from .telephony import op8_telephony
from .token_shards import op1_token_shards
from .trie_bpe import op7_trie_bpe
from .url_filter import OP3_SQL, op3_url_filter

QUERIES = {
    "op1_token_shards": op1_token_shards,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_url_filter": op3_url_filter,
    "op4_language_id": op4_language_id,
    "op5_mix_sources": op5_mix_sources,
    "op6_line_dedup": op6_line_dedup,
    "op7_trie_bpe": op7_trie_bpe,
    "op8_telephony": op8_telephony,
    "op9_quality": op9_quality,
    "op10_pseudonyms": op10_pseudonyms,
    "op11_shard_shuffle": op11_shard_shuffle,
    "op12_filter_audit": op12_filter_audit,
    "op13_periodic_runs": op13_periodic_runs,
}
ORACLE_SQL = {"op3_url_filter": OP3_SQL, "op5_mix_sources": OP5_SQL, "op6_line_dedup": OP6_SQL, "op12_filter_audit": OP12_SQL}
