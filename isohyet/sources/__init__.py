"""isohyet.sources"""
