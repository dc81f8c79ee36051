"""maskloom.operators"""
