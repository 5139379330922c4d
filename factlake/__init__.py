"""factlake: Spark-native text and claim analytics.

Every operator is a ``Column -> Column`` expression or a
``DataFrame -> DataFrame`` function whose work is done by Catalyst
expressions, joins, windows and aggregates.  Python workers are used only
where a per-document numeric routine (k-means) or a pluggable model is the
feature.
"""

from factlake.session import get_spark, checkpoint_dir  # noqa: F401

__all__ = ["get_spark", "checkpoint_dir"]
