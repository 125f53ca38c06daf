"""Tables: where their rows come from and how they are kept."""
