"""Corpus preparation operators (deduplication, filtering, mixing, tokenising). Nothing outside this subpackage imports it."""
