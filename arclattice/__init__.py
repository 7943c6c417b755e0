"""Analytics over streams of range-sensor frames, as Spark jobs."""
