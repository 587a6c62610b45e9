"""driftlog.sources"""
