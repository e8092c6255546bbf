"""Operators that prepare training data: filters, deduplication, decontamination, mixing, sharding.

Nothing outside this subpackage imports it. `queries` registers one query per operator.
"""
