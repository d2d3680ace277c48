"""tessera: record linkage as Spark DataFrame plans."""
