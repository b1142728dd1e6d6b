"""Training-data operators: filtering, deduplication, tokenising and sharding of text corpora.

Nothing outside this folder imports it; ``__spark_entry__.py`` adds its queries when it is present.
"""
