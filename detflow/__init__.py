"""detflow: determiner/noun corpus analytics as Spark DataFrame jobs."""

__all__ = ["session"]
