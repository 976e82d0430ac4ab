"""cairnlake: code-change analytics and retrieval as PySpark plans."""
