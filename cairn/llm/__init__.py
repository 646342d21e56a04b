"""Operators of a training-data pipeline: mixing, language ID, WARC, sharding,
audio fingerprints, packing, passage dedup, quality rules, Jaccard join,
SentencePiece codec, periodic runs, whitening and decontamination.  Nothing else in the library imports this subpackage."""
