"""Training-data operators: filtering, deduplication, tokenisation, packing and sharding of text corpora.

Nothing outside this subpackage imports it, so a build without it still works.
"""
