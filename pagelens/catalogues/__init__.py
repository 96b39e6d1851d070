"""Catalogues that come with the package, as JSON."""
