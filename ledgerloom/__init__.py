"""Document and ledger analytics on Spark.

Sub-packages: ``functions`` (column expressions), ``operators`` (DataFrame to DataFrame),
``sources`` and ``sinks`` (readers, writers and import layouts), ``plans`` (query catalogue),
``streaming`` (watch folders and event windows) and, where present, ``llm`` (text-corpus operators).
"""

__version__ = "0.1.0"
