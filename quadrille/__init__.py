"""Spreadsheet-style analytics compiled to Spark DataFrame plans."""
