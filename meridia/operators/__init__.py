"""Part of the spatial engine: operators."""
