"""fieldbook.streaming"""
