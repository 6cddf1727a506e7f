"""wordmine: mine a text corpus for coined words with Spark DataFrames."""

from .plans.funnel import Lexicons
from .plans.mine import mine

__all__ = ["Lexicons", "mine"]
