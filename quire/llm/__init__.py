"""Training-data operators for text (problems 1, 2, 3, 5, 6, 8, 9 and 10). Nothing else imports this subpackage."""
