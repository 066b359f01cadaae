"""Training-data operators: archives, URL lists, token files, de-duplication, scoring, filtering."""
