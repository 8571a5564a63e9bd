"""Training-data operators: ten corpus-scale stages built on DataFrames and Arrow batches.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries only
when it is present.
"""
