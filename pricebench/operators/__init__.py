"""Jobs: enrichment, grouping, statistics, quality, assessment, evaluation."""
