"""colweave.plans"""
