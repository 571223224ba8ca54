"""isohyet.plans"""
