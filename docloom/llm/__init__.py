"""Operators for building training corpora; nothing else in docloom imports them."""
