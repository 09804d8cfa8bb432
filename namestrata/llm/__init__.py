"""Operators for training-data pipelines: text, tokens and vectors at corpus scale."""
