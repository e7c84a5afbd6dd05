"""feedlens.operators"""
