"""quire: page-description documents as relational data on Spark."""
