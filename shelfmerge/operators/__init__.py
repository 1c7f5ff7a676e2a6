"""Table operators: gold tables, reports, merges, worklists, matching."""
