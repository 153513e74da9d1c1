"""gannet: object inventories as Spark tables - build, merge, query, compare, summarise, derive, remap."""
