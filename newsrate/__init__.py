"""Spark jobs that turn news feeds and posts into rated, encoded and scored text."""
