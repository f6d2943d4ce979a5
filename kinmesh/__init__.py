"""kinmesh: entity resolution and patent analytics on PySpark DataFrames."""
