"""driftlog.functions"""
