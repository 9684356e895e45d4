"""Registered queries, each with the SQL that gives the same rows where SQL can say it."""
