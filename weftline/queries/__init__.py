"""Registered queries: name -> (callable(spark, sf_dir), oracle SQL or None)."""
