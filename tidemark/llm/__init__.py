"""Training-data operators: packing, toxicity, near-duplicate join, sharding, language
identification, fingerprints, quality rules, byte-level BPE, HTML extraction, chat formatting,
suffix-array dedup, centroid clustering, embedding whitening.

Nothing else in the library imports this subpackage.
"""
