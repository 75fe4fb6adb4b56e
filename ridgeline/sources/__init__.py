"""Where corpora, models and logs come from, and where results go."""
