"""fieldbook.plans"""
