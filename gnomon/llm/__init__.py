"""Operators for preparing training data at scale.

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries when it can be imported.
"""
