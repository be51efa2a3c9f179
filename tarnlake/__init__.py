"""tarnlake: clinical and biomedical feature analytics expressed as Spark DataFrame operators."""
