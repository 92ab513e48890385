"""Training-data operators: packing, extraction, secrets, sharding, decontamination, token files, quality, near-duplicates, counts, chat.

Nothing outside this subpackage imports it; its queries are in :mod:`spanforge.llm.queries`.
"""
