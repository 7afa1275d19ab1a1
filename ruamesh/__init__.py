"""Street-network and mobility analytics expressed as Spark DataFrame plans."""
