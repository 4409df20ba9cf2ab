"""Column helpers: everything here stays inside Catalyst expressions, no Python workers."""
