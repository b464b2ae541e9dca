"""Tallystone: agreement, obligation and corpus analytics on PySpark DataFrames."""
