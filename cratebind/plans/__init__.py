"""Whole plans: the match cascade, playlist repair and the query catalogue."""
