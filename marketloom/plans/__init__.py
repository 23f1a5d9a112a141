"""marketloom.plans"""
