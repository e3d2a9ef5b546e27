"""Registry, fraud, eligibility and document analytics as Spark DataFrame jobs."""
