"""maskloom.plans"""
