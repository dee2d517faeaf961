"""The analytics as named queries, each with SQL for another engine where SQL can express it."""
