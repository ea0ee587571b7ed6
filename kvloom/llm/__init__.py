"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  Annotating operators return the
document key and their own result columns only; filtering operators return the
input columns unchanged.  Extra input columns therefore never clash with
result columns.
"""
