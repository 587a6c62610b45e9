"""driftlog.streaming"""
