"""feedlens.plans"""
