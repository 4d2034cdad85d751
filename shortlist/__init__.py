"""shortlist: collect, clean and rank job postings with Spark DataFrames."""

__version__ = "0.1.0"
