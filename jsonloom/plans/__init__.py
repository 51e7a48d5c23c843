"""jsonloom.plans"""
