"""Operations of a training-data pipeline: near-duplicate search, substring
deduplication, token counts, sharding, language ID, mixing, decontamination,
vector search, URL filters and secret scans.

Nothing outside this subpackage imports it.  Each module holds one operator
with a general interface and the thin ``opN_<name>`` query that applies it to
its whole table.
"""
