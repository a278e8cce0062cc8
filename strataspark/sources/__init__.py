"""Where observations come from and where models go to."""
