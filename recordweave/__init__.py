"""recordweave: a Spark-native record-book analytics engine.

Sub-packages: ``functions`` (column expressions), ``sources`` (tables, schema
files, text folders, sinks), ``operators`` (DataFrame -> DataFrame operators),
``plans`` (the query specification and its planner), ``streaming`` (Structured
Streaming face), ``queries`` (the registered catalogue) and the optional
``llm`` (operators on training text), which nothing else here imports.
"""

__version__ = "0.1.0"
