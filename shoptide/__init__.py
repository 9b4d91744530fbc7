"""shoptide: session-intent analytics for e-commerce clickstreams, built on Spark.

Every operator is a ``DataFrame -> DataFrame`` function over Spark's DataFrame
API; nothing is collected to the driver. See README.md for the module map.
"""

__version__ = "0.1.0"
