"""A PySpark-native process-mining engine: event logs, batch or streaming, as DataFrames."""
