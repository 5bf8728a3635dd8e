"""DataFrame operators: resolution, images, unification, provenance, reports."""
