"""Training-data operators: deduplication, filters, scoring, tokenising. Nothing else imports this package."""
