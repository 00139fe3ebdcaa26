"""Operators of the workload analyzer."""
