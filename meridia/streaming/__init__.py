"""Part of the spatial engine: streaming."""
