"""DataFrame operators: filters, search, aggregation, analysis, file history."""
