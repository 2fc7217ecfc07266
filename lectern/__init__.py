"""Document analytics and retrieval on Spark DataFrames."""

from lectern.config import DEFAULT, EngineConfig

__all__ = ["DEFAULT", "EngineConfig"]
