"""gleaner: an evidence and text-corpus engine on PySpark DataFrames."""
