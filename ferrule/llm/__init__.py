"""Operators for preparing training data. Nothing outside this folder imports it.

Modules import only what they need, so a missing optional library breaks one operator, not all.
"""
