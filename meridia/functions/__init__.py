"""Part of the spatial engine: functions."""
