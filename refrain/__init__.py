"""refrain: find the requests people keep repeating in conversation logs, on Spark.

Every operator is a function ``DataFrame -> DataFrame`` built from Spark SQL
expressions; see ``refrain.plans.scan`` for the whole pipeline.
"""

__all__ = ["session"]
