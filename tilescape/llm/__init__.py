"""Operators that prepare large text and archive collections for training."""
