"""Operators for preparing training text at scale.

Nothing else in the package imports this subpackage; ``__spark_entry__`` adds its queries when it is present.
"""
