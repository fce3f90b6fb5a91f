"""emberscan: a PySpark-native engine for night-time combustion analytics."""

__version__ = "0.1.0"
