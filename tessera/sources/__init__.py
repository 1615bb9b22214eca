"""Where rows come from and go to: engines, versioned tables, schema introspection."""
