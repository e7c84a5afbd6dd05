"""feedlens.functions"""
