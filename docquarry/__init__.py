"""A Spark engine for archives of compound office documents."""
