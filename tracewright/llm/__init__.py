"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it; its queries and oracle SQL are in
``queries.py`` and the entry module adds them only when it can be imported.
"""
