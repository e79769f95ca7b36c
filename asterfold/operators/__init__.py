"""Part of asterfold."""
