"""See README.md for what belongs here."""
