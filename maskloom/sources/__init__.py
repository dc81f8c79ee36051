"""maskloom.sources"""
