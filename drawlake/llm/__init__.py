"""Training-data operators: quality, near-duplicates, decontamination, language, PII, repeats, search, chat, WARC, packing,
token counts, lexical ranking, conversation tries.

Nothing outside this subpackage imports it.
"""
