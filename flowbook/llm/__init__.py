"""Training-data operators: quality rules, WARC round trip, quality and
toxicity scores, sharding, line and near-duplicate removal, secret scans,
packing, benchmark decontamination, centroid clustering, spelling variants and
SentencePiece ids.

Nothing outside this package imports it; ``__spark_entry__`` adds its queries
when it is present.
"""
