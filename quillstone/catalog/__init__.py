"""Registered queries: each applies operators to the test tables, with SQL for the same rows where SQL has them."""
