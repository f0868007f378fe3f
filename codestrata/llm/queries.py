"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import OP9_SQL, op9_chat_format
from .embedding import OP1_SQL, op1_embedding_dedup
from .langid import op7_language_id
from .merkle import OP10_SQL, op10_merkle_fingerprints
from .mixing import op5_pfair_mixing
from .packing import op2_kk_packing
from .periodic import op11_periodic_runs
from .pii import op13_pii
from .ranked import OP12_SQL, op12_ranked_search
from .sharding import op8_rendezvous_shards
from .simhash import op3_simhash_dedup
from .substring import OP4_SQL, op4_substring_dedup
from .urls import op6_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_embedding_dedup, op2_kk_packing, op3_simhash_dedup, op4_substring_dedup, op5_pfair_mixing,
        op6_url_filter, op7_language_id, op8_rendezvous_shards, op9_chat_format, op10_merkle_fingerprints,
        op11_periodic_runs, op12_ranked_search, op13_pii,
    )
}

SQL: dict[str, str] = {
    "op1_embedding_dedup": OP1_SQL, "op4_substring_dedup": OP4_SQL, "op9_chat_format": OP9_SQL, "op10_merkle_fingerprints": OP10_SQL,
    "op12_ranked_search": OP12_SQL,
}
