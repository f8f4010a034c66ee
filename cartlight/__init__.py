"""cartlight: Spark operators for catalogue, basket and trajectory analytics."""

__version__ = "0.1.0"
