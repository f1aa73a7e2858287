"""Operators over works and their words: frequency, difficulty, browsing, hierarchy, export."""
