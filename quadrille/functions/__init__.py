"""The function library. Importing it fills the registry."""

from quadrille.functions import dates, distributions, engineering, finance, logic, math, stats, text
from quadrille.functions.registry import FUNCTIONS, FormulaError, fn, register

__all__ = ["FUNCTIONS", "FormulaError", "dates", "distributions", "engineering", "finance", "fn", "logic", "math", "register", "stats", "text"]
