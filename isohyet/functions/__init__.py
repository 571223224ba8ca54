"""isohyet.functions"""
