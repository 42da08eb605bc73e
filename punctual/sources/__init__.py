"""Where the tables come from and where the sheets go."""
