"""Audience-signal analytics as Spark DataFrame operators.

Sub-packages: ``functions`` (Column builders), ``operators`` (DataFrame in, DataFrame
out), ``sources`` (landing, control tables, provider JSON, catalog tables), ``streaming``
(available-now ingestion), ``plans`` (whole refresh runs and read packs) and
``queries`` (the registered queries and their SQL oracles).
"""
