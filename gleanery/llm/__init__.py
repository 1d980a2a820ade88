"""Training-data operators: tokens, packing, dedup, search, formatting and scoring.

Nothing else in the library imports this subpackage.  ``llm.queries`` registers
one query per operator; each operator has its own module.
"""
