"""Whole jobs: train a model, score held-out text, evaluate induced senses."""
