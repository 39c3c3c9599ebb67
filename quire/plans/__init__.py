"""Table bindings and the registered queries with their reference SQL."""
