"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from tamarack.llm.decontam import op7_decontamination
from tamarack.llm.hnsw import op8_hnsw
from tamarack.llm.langid import op5_language_id
from tamarack.llm.mixing import OP6_SQL, op6_mixing
from tamarack.llm.secrets import op10_secret_scan
from tamarack.llm.sharding import OP4_SQL, op4_sharding
from tamarack.llm.simhash import op1_simhash
from tamarack.llm.substring import OP2_SQL, op2_substring
from tamarack.llm.tokens import op3_token_counts
from tamarack.llm.urls import OP9_SQL, op9_url_filter

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_substring": op2_substring,
    "op3_token_counts": op3_token_counts,
    "op4_sharding": op4_sharding,
    "op5_language_id": op5_language_id,
    "op6_mixing": op6_mixing,
    "op7_decontamination": op7_decontamination,
    "op8_hnsw": op8_hnsw,
    "op9_url_filter": op9_url_filter,
    "op10_secret_scan": op10_secret_scan,
}

ORACLE_SQL: dict[str, str] = {
    "op2_substring": OP2_SQL,
    "op4_sharding": OP4_SQL,
    "op6_mixing": OP6_SQL,
    "op9_url_filter": OP9_SQL,
}
