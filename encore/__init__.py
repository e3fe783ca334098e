"""Playlist analytics and continuation as Spark DataFrame jobs."""
