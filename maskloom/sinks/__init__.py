"""maskloom.sinks"""
