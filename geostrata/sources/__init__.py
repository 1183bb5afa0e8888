"""Where objects and queries come from and results go to."""
