"""Operators for training-data pipelines: deduplication, classifiers, language models, archives, tokenizers."""
