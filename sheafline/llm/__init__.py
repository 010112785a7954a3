"""Operators for preparing training text. Nothing outside this folder imports it.

Every operator takes DataFrames and column names, reads only the columns it is
told about (so extra or clashing columns of the input never matter) and states in
its docstring what nulls, empty and repeated rows give.
"""
