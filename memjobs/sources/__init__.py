"""Readers and writers: dialogue documents, saved answers, memory layers, vector logs, traces."""
