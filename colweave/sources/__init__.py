"""colweave.sources"""
