"""loomtext: text comparison, sketching, segmentation and profiling on Spark DataFrames."""

__version__ = "0.1.0"
