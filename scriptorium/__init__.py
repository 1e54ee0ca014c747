"""Document retrieval, evaluation and text-preparation engine on PySpark DataFrames."""

__version__ = "0.1.0"
