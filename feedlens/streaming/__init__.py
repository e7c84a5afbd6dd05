"""feedlens.streaming"""
