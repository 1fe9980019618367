"""Readers and writers of track files, logs, metadata and detections."""
