"""lineaweave — metadata-lineage analytics on Spark DataFrames.

Every operator takes DataFrames and returns DataFrames; graph traversals are
loops of joins whose state lives on executors, never on the driver."""

__version__ = "0.1.0"
