"""candor: review-trust analytics expressed as Spark plans."""
