"""Plans that compose operators end to end."""
