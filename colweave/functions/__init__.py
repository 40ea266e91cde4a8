"""colweave.functions"""
