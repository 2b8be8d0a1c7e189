"""Financial-ledger analytics expressed as Spark DataFrame jobs."""
