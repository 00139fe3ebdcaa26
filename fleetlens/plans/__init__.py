"""Plans of the workload analyzer."""
