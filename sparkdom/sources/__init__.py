"""Where pages come from and go to."""
