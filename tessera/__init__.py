"""tessera: clustered-sample analytics as Spark plans."""
