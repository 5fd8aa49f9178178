"""Where corpora, rules and histories come from, and where packs go."""
