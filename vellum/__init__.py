"""Vellum: analytics over legacy office documents, as Spark DataFrames."""
