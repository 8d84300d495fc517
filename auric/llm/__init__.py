"""Operators of a training-data pipeline over `documents`.

Nothing outside this folder imports it; ``__spark_entry__.py`` registers
:data:`auric.llm.queries.QUERIES` when the folder is present.
"""
