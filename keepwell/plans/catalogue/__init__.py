"""Query catalogues: each module lists {name: (query, SQL oracle or None)}."""
