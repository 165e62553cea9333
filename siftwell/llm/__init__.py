"""Operators for preparing language-model training data; nothing else in siftwell imports this subpackage."""
