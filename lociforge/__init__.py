"""Multi-locus typing, outbreak clustering and corpus preparation as PySpark DataFrame jobs."""
