"""Streaming of the workload analyzer."""
