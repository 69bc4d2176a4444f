"""Compositions: requests, paging, guarded SQL and the registered queries."""
