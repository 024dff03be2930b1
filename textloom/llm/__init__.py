"""Training-data operators: ten components over whole corpora, each in a module of its own."""
