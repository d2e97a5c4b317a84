"""Training-data operators: dedup, token counts, packing, sharding, filtering, PII.

Every operator takes DataFrames and returns DataFrames. ``loomwright.llm.queries`` holds the thin
``opN_<name>`` queries and their SQL; nothing outside this sub-package imports it.
"""
