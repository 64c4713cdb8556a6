"""Named queries over the testbed tables and their SQL counterparts."""
