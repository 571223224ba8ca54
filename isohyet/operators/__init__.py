"""isohyet.operators"""
