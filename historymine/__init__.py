"""Mine static-analysis findings over the history of a source repository, on Spark."""
