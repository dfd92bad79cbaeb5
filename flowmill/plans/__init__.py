"""Plans: documents to lazy frames, their schedule, runs and reports."""
