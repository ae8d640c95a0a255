"""Orrery: a PySpark-native analytics engine for located, time-stamped observations."""
