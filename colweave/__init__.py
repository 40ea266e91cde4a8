"""colweave: schema mapping and mapping application as Spark DataFrame operators."""
