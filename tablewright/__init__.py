"""Table preparation on Spark: profile, advise, prepare, augment, compare, model."""

__version__ = "0.1.0"
