"""Variable-length Markov chain analytics over symbol sequences, as DataFrame plans."""
