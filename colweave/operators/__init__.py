"""colweave.operators"""
