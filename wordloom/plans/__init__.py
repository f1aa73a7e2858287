"""Plans that turn input tables into works ("decks"), their words, and the dictionary."""
