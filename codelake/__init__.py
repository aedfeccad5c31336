"""codelake: software-migration analytics as Spark jobs."""
