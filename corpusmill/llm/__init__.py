"""Operators for preparing language-model training data.

One module per operator; ``queries`` registers them.  Nothing outside this
subpackage imports it.
"""
