"""Operators that prepare text for training language models, each named for its method."""
