"""Corpus preparation for language-model training, one module per operator."""
