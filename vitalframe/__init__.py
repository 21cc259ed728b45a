"""vitalframe: a PySpark-native engine for longitudinal health records and the texts around them."""

__version__ = "0.1.0"
