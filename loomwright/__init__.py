"""loomwright: a Spark-native prompt analytics engine.

Sub-packages: ``functions`` (column expressions), ``operators`` (DataFrame -> DataFrame),
``sources`` (readers and sinks), ``plans`` (composed queries), ``streaming`` (Structured
Streaming jobs) and ``llm`` (training-data pipeline operators; optional, nothing else imports it).
"""

__version__ = "0.1.0"
