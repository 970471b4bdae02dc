"""Training-data operators: decontamination, PII, tokenisation, quality, dedup, sharding, toxicity, HTML.

Nothing outside this subpackage imports it.  Every operator reads only the id and text columns it is told to,
so extra columns of any name never clash with what it computes.
"""
