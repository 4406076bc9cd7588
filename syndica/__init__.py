"""Spark-native listing extraction and feed syndication.

Everything is a ``DataFrame -> DataFrame`` transform or a ``Column -> Column``
expression; there is no engine object to create.
"""
