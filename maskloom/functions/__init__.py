"""maskloom.functions"""
