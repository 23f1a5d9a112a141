"""marketloom.streaming"""
