"""spanloom: how document chunking changes what retrieval returns, as Spark plans."""
