"""marketloom.operators"""
