"""What the shop's pages, exports and write paths compute, for all users and courses at once."""
