"""Part of lakescreen."""
