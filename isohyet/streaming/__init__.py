"""isohyet.streaming"""
