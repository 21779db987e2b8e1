"""Plan helpers: scratch tables, distributed offsets, registered queries."""
