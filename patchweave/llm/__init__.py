"""Training-data pipeline operators.

Nothing outside this subpackage imports it; ``queries`` and ``oracles`` of
:mod:`patchweave.llm.registry` are what ``__spark_entry__`` picks up.
"""
