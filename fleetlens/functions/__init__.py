"""Functions of the workload analyzer."""
