"""Readers and writers: snapshots, landed pages, manifests, rankings, publication and text checks."""
