"""Operators for preparing training data at scale.

Nothing outside this subpackage imports it.  Each module holds one operator
with a general interface; ``queries`` derives the registered digests.
"""
