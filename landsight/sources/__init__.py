"""Readers and writers: photo folders, block cubes, samples, satellite points, rasters, camera and fire lists.

No reader opens a network connection: each takes files that a fetch left, by any path that Spark reads. A failed read
is retried by Spark's own task retries (spark.task.maxFailures).
"""
