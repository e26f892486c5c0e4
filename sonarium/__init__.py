"""sonarium: landmark matching and federated catalogue analytics as Spark plans."""

__version__ = "0.1.0"
