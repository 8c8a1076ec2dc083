"""Registered queries: each Spark plan sits next to the SQL that checks it."""
