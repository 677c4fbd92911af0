"""pairloom: labelled-pair benchmark construction and scoring on Spark.

Every public operator takes DataFrames and returns DataFrames; nothing is
collected to the driver except sizes and convergence checks.
"""

__version__ = "0.1.0"
