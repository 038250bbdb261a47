"""Operators for preparing training text at scale (the numbered operators 1 to 10).

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries only
where it can be imported.
"""
