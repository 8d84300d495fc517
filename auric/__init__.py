"""auric — multi-tenant bullion-token ledger analytics on Spark.

Every operator is a plain ``DataFrame -> DataFrame`` function; nothing in the
library triggers an action except the sinks in ``auric.sources.sinks`` and the
streaming job starters in ``auric.streaming``.
"""

__version__ = "0.1.0"
