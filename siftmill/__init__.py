"""siftmill: evidence screening at corpus scale, expressed as Spark DataFrame transformations."""

__version__ = "0.1.0"
