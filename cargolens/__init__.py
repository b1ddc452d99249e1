"""Cargolens: demand, warehouse, location, customer and delivery-time analytics on Spark.

Every operator takes DataFrames and returns a lazy DataFrame keyed by its group
columns, so one plan serves one series or millions of them.
"""
