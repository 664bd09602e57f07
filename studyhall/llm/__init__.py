"""Operators of a training-data pipeline: chat formatting, toxicity, packing, LM scoring, source
mixing, near-duplicates of texts and vectors, personal data, fingerprints and language id.

Each module holds one operator with its own general interface; ``queries`` derives the registered
digests from them. Nothing else in the library imports this subpackage.
"""
