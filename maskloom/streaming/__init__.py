"""maskloom.streaming"""
