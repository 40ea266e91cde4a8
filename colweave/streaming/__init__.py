"""colweave.streaming"""
