"""Part of lemmagraph; see the README for the layout."""
