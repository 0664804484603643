"""Query language and search schema: pure Python, no session needed."""
