"""Registered queries: operators applied to the verification tables, and the SQL that gives the same rows."""
