"""Operators for preparing training text: scoring, filtering, linking, sharding and encoding.

Each operator reads the columns it names and returns the columns its docstring
lists, so further columns of the input, whatever they are called, never clash.
A missing table is an error; an empty one gives an empty result.
"""
