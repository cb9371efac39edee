"""Part of the leafline document-structure engine."""
