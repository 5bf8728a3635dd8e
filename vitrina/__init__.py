"""vitrina: product-catalogue enrichment as Spark DataFrame operators.

Every operator is a function from DataFrames (or Columns) to a DataFrame (or a
Column).  Brand-specific behaviour lives in rows of the profile table
(:mod:`vitrina.lexicon`), never in separate code paths.
"""

__version__ = "0.1.0"
