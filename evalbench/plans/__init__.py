"""Named query plans and their SQL forms."""
