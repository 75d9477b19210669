"""Part of quillon; see the README for the layout."""
