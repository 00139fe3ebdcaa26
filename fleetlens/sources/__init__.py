"""Sources of the workload analyzer."""
