"""DataFrame operators: extraction, reconciliation, rules, scoring, comparison, drills and reviews."""
