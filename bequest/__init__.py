"""Estate records (wills, assets, shares, transfers, audit) as Spark DataFrame jobs."""
