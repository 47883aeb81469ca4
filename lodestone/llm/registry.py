"""The modules whose queries ``__spark_entry__.py`` registers."""

from lodestone.llm import audit, clusters, lines, neardup, overlap, packing, pieces, pii, sharding, topk, toxicity, urls, warc

MODULES = [sharding, toxicity, pii, urls, overlap, neardup, pieces, warc, topk, packing, lines, audit, clusters]
