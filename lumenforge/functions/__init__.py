"""Part of lumenforge."""
