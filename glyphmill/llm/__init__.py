"""Training-data operators: one module per operator, ``queries`` holds the registered query set.

Nothing outside this subpackage imports it.
"""
