"""panelframe: entity x date panel analytics on PySpark DataFrames."""
