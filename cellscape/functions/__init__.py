"""Part of the cellscape engine."""
