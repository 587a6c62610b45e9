"""driftlog.plans"""
