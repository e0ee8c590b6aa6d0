"""boxlake: detection geometry, dataset curation and embedding evaluation on Spark."""

__version__ = "0.1.0"
