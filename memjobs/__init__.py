"""PySpark jobs for conversational memory at scale."""
