"""cairn: a Spark-native verifiable memory, retrieval and data-processing engine.

Every operator is a function over DataFrames; nothing here starts Spark on
import.  See README.md for the operator catalogue.
"""

__version__ = "0.1.0"
