"""Spark-first analytics over multi-camera 3D motion data."""
