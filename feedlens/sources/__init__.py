"""feedlens.sources"""
