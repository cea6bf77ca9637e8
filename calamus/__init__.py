"""calamus: stylometry and same-author testing as Spark DataFrame plans."""

__version__ = "0.1.0"
