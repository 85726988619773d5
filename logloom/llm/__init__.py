"""Operators for preparing language-model training corpora.

Nothing outside this subpackage imports it; ``__spark_entry__.py`` adds its queries when the
folder is present.
"""
