"""driftlog.operators"""
