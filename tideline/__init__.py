"""Sensor-message analytics as PySpark DataFrame transforms."""
