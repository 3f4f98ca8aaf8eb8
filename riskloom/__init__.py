"""Transaction-risk features, training sets and scoring as Spark jobs."""

__version__ = "0.1.0"
