"""Operators for building language-model training corpora; nothing outside this folder imports it."""
